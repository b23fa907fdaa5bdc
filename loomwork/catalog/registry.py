"""The list of named queries: a Spark callable and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.operators.hot import LIST_ROWS
from loomwork.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def numbered_sql(source: str, key: str, order: str) -> str:
    """``source`` with ``part_no``, the part of its key's list that a row lies in."""
    return f"(select *, (row_number() over (partition by {key} order by {order}) - 1) // {LIST_ROWS} as part_no from {source})"


def rollup_sql(source: str, key: str, lists: dict[str, bool], more: dict[str, str] | None = None) -> str:
    """SQL of ``rollup_text``: row counts, further aggregates, and sorted lists in parts."""
    more = more or {}
    steps = [f"base as ({source})", f"totals as (select {key}, count(*) as n_rows{''.join(f', {x} as {n}' for n, x in more.items())} from base group by {key})"]
    for i, (c, distinct) in enumerate(lists.items()):
        values = f"(select {'distinct ' if distinct else ''}{key}, {c} as v from base where {c} is not null)"
        steps.append(f"l{i} as (select {key}, part_no, string_agg(v, ',' order by v) as v from {numbered_sql(values, key, 'v')} group by {key}, part_no)")
    steps.append(f"parts as (select {key}, 0::bigint as part_no from totals" + "".join(f" union select {key}, part_no from l{i}" for i in range(len(lists))) + ")")
    joins = "".join(f" left join l{i} on p.{key} is not distinct from l{i}.{key} and p.part_no = l{i}.part_no" for i in range(len(lists)))
    return (f"with {', '.join(steps)} select p.{key}, p.part_no, n_rows{''.join(f', {n}' for n in more)}" + "".join(f", coalesce(l{i}.v, '') as {c}" for i, c in enumerate(lists))
            + f" from parts p join totals t on p.{key} is not distinct from t.{key}{joins}")


class Tables:
    """The tables of one folder; ``t.orders`` is a DataFrame on ``orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
