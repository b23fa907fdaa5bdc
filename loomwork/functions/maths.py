"""Numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return magnitude(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def compound(principal: Column, rate: Column, years: Column, per_year: int = 12) -> Column:
    return principal * F.pow(1 + rate / per_year, years * per_year)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def floor_div(a: Column, b) -> Column:
    """Whole-number division rounded down; ``a`` and ``b`` whole numbers."""
    b = b if isinstance(b, Column) else F.lit(b)
    return (a - floor_mod(a, b)) / b


def floor_mod(a: Column, b) -> Column:
    """Remainder with the sign of the divisor."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a % b) + b) % b


def wrap_unsigned(value: Column, bits: int) -> Column:
    size = F.lit(str(2 ** bits)).cast("decimal(38,0)")
    return F.pmod(value.cast("decimal(38,0)"), size)


def wrap_signed(value: Column, bits: int) -> Column:
    size, half = (F.lit(str(2 ** n)).cast("decimal(38,0)") for n in (bits, bits - 1))
    low = wrap_unsigned(value, bits)
    return F.when(low >= half, low - size).otherwise(low)


def calculate(a: Column, b: Column, operator: Column) -> Column:
    """The result as text, or the message for a bad operand or operator."""
    return (F.when(a.isNull() | b.isNull(), "Error: Both inputs must be numbers.")
            .when(operator == "+", F.round(a + b, 4).cast("string"))
            .when(operator == "-", F.round(a - b, 4).cast("string"))
            .when((operator == "/") & (b == 0), "Error: Cannot divide by zero.")
            .when(operator == "/", F.round(F.try_divide(a, b), 4).cast("string"))
            .otherwise(F.concat(F.lit("Unknown operator: '"), operator, F.lit("'"))))


def next_band(text: Column, default: int | None = None) -> Column:
    """One more than the number in a text; ``default`` where there is none."""
    band = text.try_cast("int") + 1
    return band if default is None else F.coalesce(band, F.lit(default))


def area(shape: Column, a: Column, b: Column) -> Column:
    """Area by shape: circle (radius), rectangle, triangle, polygon (sides, side length)."""
    return (F.when(shape == "circle", F.lit(3.141592653589793) * a * a).when(shape == "rectangle", a * b)
            .when(shape == "triangle", a * b * 0.5)
            .when(shape == "polygon", a * b * b / (F.tan(F.lit(3.141592653589793) / a) * 4)))


def body_mass(weight_kg: Column, height_m: Column) -> Column:
    return weight_kg / F.pow(height_m, 2)
