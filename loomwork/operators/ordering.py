"""Sorting, limits, top-k and set operations.

A table has no order of its own, so ordered results carry their position. The
position of a row over the whole table comes from ``hot.numbered``, which never
brings the table into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.hot import numbered, sort_columns


def sorted_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    return numbered(df, [], order, name)


def take(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of an order; each task keeps n rows."""
    return df.orderBy(*sort_columns(order)).limit(n)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """The same rows in a random order."""
    return df.orderBy(F.rand(seed))


def any_one(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Some value per key, always the same one: the smallest."""
    return df.groupBy(*keys).agg(F.min(value).alias(name))


def layered(layers: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Key/value layers merged; a later layer wins."""
    rows = None
    for i, layer in enumerate(layers):
        layer = layer.select(key, value, F.lit(i).alias("__layer"))
        rows = layer if rows is None else rows.unionByName(layer)
    return rows.groupBy(key).agg(F.max_by(value, "__layer").alias(value))
