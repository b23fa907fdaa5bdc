"""Grouping sets, cube and rollup from one pass over the rows.

The rows are grouped once, by all columns. A coarser set is grouped from the
states (counts, sums, least, largest) of the smallest set already made that holds
its columns, so its cost follows the number of groups, not of rows; rows are
not multiplied by the number of sets. Distinct counts need the values themselves: they
come from the distinct (group, value) pairs, made coarser in the same order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.hot import _staged


def rollup_sets(columns: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(columns[:n]) for n in range(len(columns), -1, -1)]


def cube_sets(columns: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(columns), -1, -1) for c in combinations(columns, n)]


def _states(measures: Mapping[str, tuple[str, str]]) -> dict[str, tuple[str, Column, str]]:
    """name -> (kind of merge, first aggregate, column) of each state; equal states are kept once."""
    out = {}
    for kind, column in measures.values():
        col = F.lit(1) if column == "*" else F.col(column)
        if kind in ("count", "avg"):
            out[f"__count_{column}"] = ("sum", F.count(col))
        if kind in ("sum", "avg"):
            out[f"__sum_{column}"] = ("sum", F.sum(col))
        if kind in ("min", "max"):
            out[f"__{kind}_{column}"] = (kind, getattr(F, kind)(col))
        if kind not in ("count", "avg", "sum", "min", "max", "distinct"):
            raise ValueError(f"no measure {kind}")
    return out


def grouping_sets(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``column..., grouping_id, measure...``: one row per group of each set.

    measures: name -> (kind, column); kinds are count (of ``"*"`` or a column), sum, avg, min, max and distinct (number of different values). A column that
    a set leaves out is null there and has its bit in ``grouping_id`` (the first column's is the highest); a null of the data is a group of its own.
    Nulls do not count in measures of a column. A set given twice comes once. The empty set has one row also for an empty table.
    One pass over ``df`` if at most one column is counted distinct, and one more for each further one.
    """
    columns = list(columns)
    wanted = []
    for s in sets:
        if set(s) - set(columns):
            raise ValueError("a set names a column that is not among the columns")
        own = tuple(c for c in columns if c in s)
        if own not in wanted:
            wanted.append(own)
    states = _states(measures)
    merge = [getattr(F, kind)(F.col(f"`{s}`")).alias(s) for s, (kind, _) in states.items()]
    distinct = list(dict.fromkeys(c for kind, c in measures.values() if kind == "distinct"))
    full = tuple(columns)
    order = sorted({*wanted, full}, key=lambda s: -len(s))
    parent = {s: min((p for p in order if set(s) < set(p)), key=len, default=None) for s in order}
    kept = set(parent.values())

    first = [a.alias(s) for s, (_, a) in states.items()] or [F.count(F.lit(1)).alias("__rows")]
    pairs: dict[tuple[tuple[str, ...], str], DataFrame] = {}
    if distinct:
        # the first distinct column joins the one pass
        fine = _staged(df.groupBy(*columns, F.col(distinct[0]).alias("__x")).agg(*first), "finest-pairs")
        top = fine.groupBy(*columns).agg(*merge) if states else fine.select(*columns).distinct()
        pairs[full, distinct[0]] = fine.select(*columns, "__x").where("__x is not null")
        for c in distinct[1:]:
            pairs[full, c] = _staged(df.select(*columns, F.col(c).alias("__x")).where("__x is not null").distinct(), "pairs")
    else:
        top = df.groupBy(*columns).agg(*first)
    groups = {full: _staged(top, "finest") if full in kept else top}
    for s in order:
        if s == full:
            continue
        up = parent[s]
        coarser = groups[up].groupBy(*s).agg(*merge) if states else groups[up].select(*s).distinct() if s else groups[up].agg(F.count(F.lit(1)).alias("__rows"))
        groups[s] = _staged(coarser, "coarser") if s in kept else coarser
        for c in distinct:
            coarser = pairs[up, c].select(*s, "__x").distinct()
            pairs[s, c] = _staged(coarser, "coarser-pairs") if s in kept else coarser

    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = None
    for s in wanted:
        rows = groups[s]
        for i, c in enumerate(distinct):
            n = pairs[s, c].groupBy(*[F.col(x).alias(f"__g{k}") for k, x in enumerate(s)]).agg(F.count("__x").alias(f"__distinct_{i}"))
            # (the empty set has one row on both sides)
            rows, n = rows.withColumn("__one", F.lit(1)), n.withColumn("__two", F.lit(1))
            match = F.col("__one") == F.col("__two")
            for k, x in enumerate(s):
                match = match & rows[x].eqNullSafe(n[f"__g{k}"])
            rows = rows.join(n, match, "left").drop("__one", "__two", *[f"__g{k}" for k in range(len(s))])
        bits = sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in s)
        line = rows.select(*[F.col(c) if c in s else F.lit(None).cast(kinds[c]).alias(c) for c in columns], F.lit(bits).cast("long").alias("grouping_id"),
                           *[_measure(kind, c, distinct).alias(name) for name, (kind, c) in measures.items()])
        out = line if out is None else out.unionByName(line)
    return out


def _measure(kind: str, column: str, distinct: list[str]) -> Column:
    count, total = F.col(f"`__count_{column}`"), F.col(f"`__sum_{column}`")
    if kind == "count":
        return F.coalesce(count, F.lit(0)).cast("long")
    if kind == "avg":
        return F.when(count > 0, total / count)
    if kind == "distinct":
        return F.coalesce(F.col(f"__distinct_{distinct.index(column)}"), F.lit(0)).cast("long")
    return F.col(f"`__{kind}_{column}`")


def rollup(df: DataFrame, columns: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    return grouping_sets(df, columns, rollup_sets(columns), measures)


def cube(df: DataFrame, columns: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    return grouping_sets(df, columns, cube_sets(columns), measures)
