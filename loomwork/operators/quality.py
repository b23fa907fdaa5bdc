"""Data-quality checks. Bad rows are reported, never dropped in silence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_errors(checks: Sequence[tuple[Column, str]]) -> Column:
    """The codes of all failed checks of a row: ``checks`` are (bad, code)."""
    found = F.array(*[F.when(bad, F.lit(code)) for bad, code in checks])
    return F.filter(found, lambda x: x.isNotNull())


def parse_number_lines(lines: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """Comma-separated whole numbers: rows with ``numbers``, and the bad lines with ``cause``."""
    cells = F.transform(F.split(text, ","), lambda cell: F.trim(cell))
    rows = lines.withColumn("__cells", cells)
    # bad cells: those that are no whole number
    rows = rows.withColumn("__bad", F.expr("filter(__cells, x -> try_cast(x as int) is null)"))
    good = (rows.where(F.size("__bad") == 0)
            .withColumn("numbers", F.expr("transform(__cells, x -> cast(x as int))")).drop("__cells", "__bad"))
    bad = rows.where(F.size("__bad") > 0).withColumn(
        "cause", F.concat(F.lit("not a number: "), F.col("__bad")[0])).drop("__cells", "__bad")
    return good, bad


@dataclass(frozen=True)
class Range:
    low: float
    high: float

    def holds(self, value: Column) -> Column:
        return value.between(self.low, self.high)


@dataclass(frozen=True)
class MaxLen:
    length: int

    def holds(self, value: Column) -> Column:
        return F.length(value) <= self.length


@dataclass(frozen=True)
class Pattern:
    """The whole text has to match."""

    pattern: str

    def holds(self, value: Column) -> Column:
        return value.rlike(f"^(?:{self.pattern})$")


def rule_errors(rules: dict[str, Sequence]) -> Column:
    """Failed rules of a row as ``Rule failed for column``."""
    return all_errors([(~rule.holds(F.col(column)), f"{type(rule).__name__} failed for {column}")
                       for column, checks in rules.items() for rule in checks])


def shape_report(df: DataFrame, declared: T.StructType, optional: Sequence[str] = ()) -> DataFrame:
    """One row per declared column: is it there, has it the declared type, how many nulls.

    ``problem`` names what is wrong; an optional column may be missing.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    present = [f.name for f in declared.fields if f.name in have]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    entries = []
    for f in declared.fields:
        here, fits = f.name in have, have.get(f.name) == f.dataType
        nulls = F.col(f.name) if here else F.lit(None).cast("bigint")
        needed = f.name not in optional
        problem = F.lit(None).cast("string")
        if not here and needed:
            problem = F.lit("missing")
        elif here and not fits:
            problem = F.lit(f"type {have[f.name].simpleString()}")
        elif here and needed and not f.nullable:
            problem = F.when(nulls > 0, F.lit("null in required column"))
        entries.append(F.struct(F.lit(f.name).alias("name"), F.lit(here).alias("present"), F.lit(here and fits).alias("type_ok"),
                                nulls.alias("nulls"), problem.alias("problem")))
    return counts.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def email_status(email: Column, domain: str) -> Column:
    """``error`` without @, ``warning`` for another domain, else ``ok``."""
    return (F.when(~email.contains("@"), "error").when(~email.endswith(f"@{domain}"), "warning").otherwise("ok"))


def all_positive(*values: Column) -> Column:
    return F.array_min(F.array(*[v.cast("double") for v in values])) > 0
