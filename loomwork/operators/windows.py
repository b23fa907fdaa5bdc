"""Ordered operators per key. Numbering and running sums come from ``hot`` and survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.hot import HOT_ROWS, collect_ordered, neighbours, numbered, running_sum, sort_columns


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key. A grouped minimum, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__r.{c}") for c in df.columns])


def dense_rank_of(df: DataFrame, order: Sequence[str], name: str = "dense_value") -> DataFrame:
    """``dense_rank()`` over the whole table: number the distinct keys, then join the number back."""
    ranks = numbered(df.select(*order).distinct(), [], order, name)
    match = F.lit(True)
    for c in order:
        match = match & df[c].eqNullSafe(ranks[c])
    return df.join(ranks, match).drop(*[ranks[c] for c in order])


def sliding(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int,
            rows: int = HOT_ROWS) -> DataFrame:
    """Every full window of ``size`` consecutive values, as arrays."""
    def make(w):
        return {"window": F.collect_list(value).over(w.rowsBetween(-(size - 1), 0))}
    return neighbours(df, keys, order, make, back=size - 1, rows=rows).where(F.size("window") == size)


def take_until(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit) -> DataFrame:
    """Rows as long as the sum of the rows *before* them is at most ``limit``.

    Sums of decimals and whole numbers are exact. Sums of doubles depend on how the rows are dealt, and with them, near the limit, the rows.
    """
    rows = running_sum(df, keys, order, value, "total")
    return rows.where(F.col("total") - F.col(value) <= limit)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows per key.

    ``row_number() <= n`` is cut to n rows per key before the shuffle
    (WindowGroupLimit), so a hot key sends n rows per task.
    """
    back = [o[1:] if o.startswith("-") else f"-{o}" for o in order]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_columns(back)))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def first_and_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, value: str) -> DataFrame:
    """First and last row that meets a condition: its value and its index from 0 (null and -1 if none)."""
    rows = numbered(df, keys, order, "__i").withColumn("__h", F.when(hit, F.col("__i")))
    return rows.groupBy(*keys).agg(
        F.min_by(value, "__h").alias("first_value"), (F.coalesce(F.min("__h"), F.lit(0)) - 1).alias("first_index"),
        F.max_by(value, "__h").alias("last_value"), (F.coalesce(F.max("__h"), F.lit(0)) - 1).alias("last_index"))


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, size: int) -> DataFrame:
    """Members in order, ``size`` to a row: ``(key..., part_no, items)``."""
    rows = numbered(df, keys, order, "__rn").withColumn("part_no", F.floor((F.col("__rn") - 1) / size))
    packed = F.sort_array(F.collect_list(F.struct("__rn", value.alias("v"))))
    return (rows.groupBy(*keys, "part_no").agg(packed.alias("l")).select(*keys, "part_no", F.col("l.v").alias("items")))


def from_end(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, positions: Sequence[int]) -> DataFrame:
    """The values at -1, -2, ... per key; null when the key has fewer rows."""
    deepest = max(-p for p in positions)
    tail = last_n(df, keys, order, deepest)
    packed = collect_ordered(tail, keys, order, F.col(value), per_row=max(deepest, 1_000))
    return packed.select(*keys, *[F.try_element_at("items", F.lit(p)).alias(f"at_{-p}") for p in positions])
