"""Arrays and maps inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.hot import collect_ordered


def flat(value: Column, levels: int = 1) -> Column:
    """Take away ``levels`` levels of nesting."""
    for _ in range(levels):
        value = F.flatten(value)
    return value


def without_holes(value: Column) -> Column:
    return F.filter(value, lambda x: x.isNotNull())


def splice(value: Column, start: int, remove: int, *insert: Column) -> Column:
    """Remove ``remove`` entries at ``start`` (from 0) and put others there."""
    head = F.slice(value, F.lit(1), F.least(F.lit(start), F.size(value)))
    tail = F.slice(value, F.lit(start + remove + 1), F.greatest(F.size(value) - start - remove, F.lit(0)))
    return F.concat(head, F.array(*insert), tail) if insert else F.concat(head, tail)


def with_at(value: Column, index: int, new: Column) -> Column:
    """The entry at ``index`` replaced; a negative index counts from the end."""
    at = F.lit(index) if index >= 0 else F.size(value) + index
    return F.transform(value, lambda x, i: F.when(i == at, new).otherwise(x))


def contains_from(value: Column, item: Column, start: int = 0) -> Column:
    """Is the item in the array at ``start`` or later?"""
    return F.array_contains(F.slice(value, F.lit(start + 1), F.greatest(F.size(value), F.lit(1))), item)


def index_of(value: Column, item: Column) -> Column:
    """Index from 0, -1 if missing."""
    return F.array_position(value, item).cast("int") - 1


def zip_short(a: Column, b: Column, join) -> Column:
    """Pair two arrays up to the end of the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), join)


def tail(value: Column) -> Column:
    return F.slice(value, F.lit(2), F.greatest(F.size(value), F.lit(1)))


def map_text(value: Column) -> Column:
    """A map as sorted text ``k=v,k=v``."""
    entries = F.array_sort(F.map_entries(value))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")


def transpose(df: DataFrame, row: str, cells: str, per_row: int | None = None) -> DataFrame:
    """Columns of a matrix whose rows are arrays: ``(col, part_no, items)`` in row order."""
    long = df.select(row, F.posexplode(cells).alias("col", "cell"))
    return collect_ordered(long, ["col"], [row], F.col("cell"), per_row)
