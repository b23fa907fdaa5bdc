"""Roll-ups. Every one combines on the map side; lists are built by ``hot``, which bounds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.hot import collect_values, running_sum


def rollup_text(df: DataFrame, keys: Sequence[str], lists: dict[str, bool], more: Sequence[Column] = (),
                sep: str = ",", **options) -> DataFrame:
    """Per key the row count and the sorted values of some text columns, joined.

    True in ``lists`` means distinct values. One row per key; a key with more
    than ``per_row`` values goes on in further parts (``part_no``).
    """
    rows = collect_values(df, keys, lists, more, **options)
    return rows.withColumns({c: F.array_join(c, sep) for c in lists})


def mean_or_zero(value: Column) -> Column:
    """Mean as a double, 0 for no rows. A decimal input is summed exactly, in any order."""
    return F.coalesce(F.try_divide(F.sum(value).cast("double"), F.count(value)), F.lit(0.0))


def any_of(value: Column, codes: Sequence[str]) -> Column:
    """'Y' if a row of the group has one of the codes, else 'N'."""
    return F.when(F.coalesce(F.bool_or(value.isin(list(codes))), F.lit(False)), "Y").otherwise("N")


def to_wide(params: DataFrame, owner: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Attribute rows to one row per owner with a column per listed name (the largest value)."""
    return (params.where(F.col(name).isin(list(names))).groupBy(owner)
            .pivot(name, list(names)).agg(F.max(value)))


def words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word, lower case, split at white space."""
    cut = F.split(F.lower(F.col(text)), r"\s+")
    return df.select(*keep, F.explode(cut).alias("word")).where("word <> ''")


def frequencies(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def split_outcomes(df: DataFrame, ok: Column, good: Column, reason: Column) -> DataFrame:
    """Every row with ``status`` fulfilled/rejected and the value or the reason."""
    return df.select("*", F.when(ok, "fulfilled").otherwise("rejected").alias("status"),
                     F.when(ok, good).alias("value_out"), F.when(~ok, reason).alias("reason"))


def cart_totals(df: DataFrame, owner: str, order: Sequence[str], action: str, item: str, price: str) -> DataFrame:
    """Fold add / remove / clear actions per owner: ``(owner, items, total)``.

    A clear empties the cart. A remove takes every piece of the item out but
    lowers the total by the price of the first one only; removing what is not
    there changes nothing. Rows after the last clear are cut into the stretches
    between two removes of an item; sums of stretches give the end state.
    """
    at = F.struct(*order)
    cleared = (df.groupBy(owner).agg(F.max(F.when(F.col(action) == "clear", at)).alias("__clear")))
    rows = (df.where(F.col(action).isin("add", "remove", "clear")).join(cleared, owner)
            .where((F.col("__clear").isNull() | (at > F.col("__clear"))) & (F.col(action) != "clear")))
    rows = rows.withColumn("__cut", (F.col(action) == "remove").cast("int"))
    rows = running_sum(rows, [owner, item], order, "__cut", "__stretch")
    rows = rows.withColumn("__stretch", F.col("__stretch") - F.col("__cut"))
    added = F.col(action) == "add"
    stretches = rows.groupBy(owner, item, "__stretch").agg(
        F.sum(F.when(added, F.col(price)).otherwise(0.0)).alias("__sum"),
        F.count_if(added).alias("__n"), F.max("__cut").alias("__closed"),
        F.min_by(price, F.when(added, at)).alias("__first"))
    closed = F.col("__closed") == 1
    ends = stretches.groupBy(owner).agg(
        F.sum(F.when(closed, 0).otherwise(F.col("__n"))).alias("items"),
        F.sum(F.col("__sum") - F.when(closed, F.coalesce("__first", F.lit(0.0))).otherwise(0.0)).alias("total"))
    empty = cleared.select(owner)
    return (empty.join(ends, owner, "left")
            .select(owner, F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("total", F.lit(0.0)).alias("total")))
