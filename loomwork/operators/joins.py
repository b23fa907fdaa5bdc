"""Joins and lookups.

No side is broadcast by hand unless it was built from literals: adaptive
execution broadcasts a side when its measured size allows it, and splits the
partitions of a skewed key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def left_lookup(df: DataFrame, facts: DataFrame, keys: Sequence[str], ident: Sequence[str]) -> DataFrame:
    """``df`` left-joined to ``facts`` on the columns ``keys`` of both, where many rows of ``df`` may have no key or the same one.

    A plain left join deals all rows without a key to one task. Here a hash is one more join column: of the key, or where a part of the key is null (such a row
    matches nothing) of the columns ``ident``, which tell the rows apart. It also gives grouped facts a shuffle of their own, so that
    adaptive execution may split a frequent key.
    """
    for k in keys:
        kind = df.schema[k].dataType
        if kind != facts.schema[k].dataType or isinstance(kind, T.FractionalType):
            raise ValueError(f"{k} has to be of one type on both sides, and no fraction, so that equal keys have equal hashes")
    key = F.xxhash64(*keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    dealt = df.withColumn("__deal", F.when(whole, key).otherwise(F.xxhash64(*ident)))
    return dealt.join(facts.withColumn("__deal", key), [*keys, "__deal"], "left").drop("__deal")


def flag_present(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """Add 'Y'/'N': does the key occur in the other table? Never multiplies rows."""
    keys = other.select(F.col(other_key).alias("__k")).where("__k is not null").distinct()
    out = df.join(keys, df[key] == keys["__k"], "left")
    return out.withColumn(name, F.when(F.col("__k").isNotNull(), "Y").otherwise("N")).drop("__k")


def linked_record(df: DataFrame, owner: str, shared: Sequence[str], allowed: Column | None = None) -> DataFrame:
    """For every row the smallest *other* owner with the same shared values, and how many there are.

    ``allowed`` restricts which rows may be linked to. The two smallest owners
    per shared value say it all, so no pair of rows is ever built.
    """
    pool = df if allowed is None else df.where(allowed)
    pool = pool.select(*shared, owner).distinct()
    lowest = pool.groupBy(*shared).agg(F.min(owner).alias("__first"), F.count(F.lit(1)).alias("__n"))
    second = (pool.join(lowest.where("__n > 1"), list(shared)).where(F.col(owner) > F.col("__first"))
              .groupBy(*shared).agg(F.min(owner).alias("__second")))
    best = lowest.join(second, list(shared), "left")
    own = pool.withColumn("__in", F.lit(1))
    out = df.join(best, list(shared), "left").join(own, [*shared, owner], "left")
    linked = F.when(F.col("__first") != F.col(owner), F.col("__first")).otherwise(F.col("__second"))
    others = F.coalesce("__n", F.lit(0)) - F.coalesce("__in", F.lit(0))
    return (out.withColumn("linked", linked).withColumn("n_linked", others.cast("bigint"))
            .drop("__first", "__second", "__n", "__in"))


def bundle_values(params: DataFrame, owner: str, name: str, value: str, bundle: str, wanted: Sequence[str]) -> DataFrame:
    """Per bundle, one non-empty value (the smallest) of each wanted attribute of any of its owners."""
    members = params.where(F.col(name) == bundle).select(owner, F.col(value).alias("bundle")).distinct()
    facts = params.where(F.col(name).isin(list(wanted)) & (F.col(value) != ""))
    facts = facts.groupBy(owner).agg(*[F.min(F.when(F.col(name) == w, F.col(value))).alias(w) for w in wanted])  # one row per owner is shuffled
    return facts.join(members, owner).groupBy("bundle").agg(*[F.min(w).alias(w) for w in wanted])


def range_lookup(df: DataFrame, rules: DataFrame, on: Column, value: Column, low: str, high: str) -> DataFrame:
    """Rules that hold for the key while ``low <= value <= high``; an equi-join with a range on top."""
    return df.join(rules, on & value.between(F.col(low), F.col(high)))


def with_fallback(first: Column, second: Column) -> Column:
    """The second source where the first is missing or blank."""
    return F.coalesce(F.nullif(F.rtrim(first), F.lit("")), second)


def keep_prior(found: Column, hit: Column, prior: Column) -> Column:
    """Assignment by a query that may find no row: without a row the old value stays."""
    return F.when(hit, found).otherwise(prior)
