"""Defaults, tests and classification of single values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def present_or(*columns: Column) -> Column:
    """The first value that is not null; 0, empty text and false count as present."""
    return F.coalesce(*columns)


def truthy_or(value: Column, default: Column, empty=0) -> Column:
    """``default`` where the value is null or ``empty`` (0, '' or false)."""
    return F.when(value.isNull() | (value == F.lit(empty)), default).otherwise(value)


def if_present(value: Column, change) -> Column:
    """``change(value)`` where there is a value; null and empty text stay as they are."""
    return F.when(value.isNotNull() & (value != ""), change(value)).otherwise(value)


def is_blank(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) == ""


def in_text_list(text: Column, value: Column) -> Column:
    """Is ``value`` one of the comma-separated entries? An empty list allows everything."""
    return (F.coalesce(text, F.lit("")) == "") | F.array_contains(F.split(text, ","), value)


def one_of_ignoring_case(value: Column, choices: Sequence[str]) -> Column:
    return F.upper(value).isin([c.upper() for c in choices])


def contains_ignoring_case(value: Column, part: str) -> Column:
    return F.lower(value).contains(part.lower())


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """The result of the first rule whose condition is true."""
    result = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(default if isinstance(default, Column) else F.lit(default))


def last_match(rules: Sequence[tuple[Column, object]], start: Column) -> Column:
    """Rules that overwrite each other: the last true one counts."""
    return first_match(list(reversed(rules)), start)


def by_literal(value: Column, results: dict, default=None) -> Column:
    return first_match([(value == k, v) for k, v in results.items()], default)


def as_int_or(text: Column, default: int) -> Column:
    """Text as a whole number, ``default`` where it is none."""
    return F.coalesce(text.try_cast("int"), F.lit(default))


def same_row(a: Column, b: Column) -> Column:
    """Equality of structs; null fields equal each other."""
    return a.eqNullSafe(b)
