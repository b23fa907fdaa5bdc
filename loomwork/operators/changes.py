"""Table changes. A change reads one table version and gives the next one; nothing is edited in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.hot import numbered


def last_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One change per key: the latest. A grouped maximum, combined before the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Update the value where the key exists, insert the key where it does not."""
    last = last_per_key(changes.select(*keys, value, *order), keys, order)
    last = last.select(*keys, F.struct(value).alias("__new"))
    out = base.join(last, list(keys), "full_outer")
    return out.withColumn(value, F.when(F.col("__new").isNotNull(), F.col(f"__new.{value}")).otherwise(F.col(value))
                          ).drop("__new")


def insert_missing(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.unionByName(rows.join(base.select(*keys), list(keys), "left_anti"))


def update_where(df: DataFrame, condition: Column, **new: Column) -> DataFrame:
    """Set columns where the condition is true; all new values see the old row."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition is false or unknown stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys), list(keys), "left_anti")


def allocate(df: DataFrame, order: Sequence[str], counter: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Give every row the next number of a one-row counter table ``(value)``.

    Returns the numbered rows and the new counter table.
    """
    start = counter.select("value").scalar()
    rows = numbered(df, [], order, name).withColumn(name, F.col(name) + start)
    after = df.agg((F.count(F.lit(1)) + start).alias("value"))
    return rows, after


def odometer(n: Column, prefix: str, letters: str, number: int) -> Column:
    """The serial handed out after ``n`` earlier ones.

    Three digits run from 001 to 999, then two letters step from AA to ZZ, then
    the two characters that end the prefix rise by one, written without a
    leading zero. So a prefix that ends in 01 loses a character at its first
    step (``..X01`` to ``..X2``), and the next one reads the digit before it
    too (``..12`` to ``..113``). Where that has no meaning (past 99, or no
    digit there) the row fails.
    """
    at = n + (number - 1)
    step = F.floor(at / 999) + (ord(letters[0]) - 65) * 26 + (ord(letters[1]) - 65)
    digits = F.lpad((at % 999 + 1).cast("string"), 3, "0")
    pair = step % 676
    # letter codes: 'A' is 65
    text = F.concat(F.chr((F.floor(pair / 26) + 65)), F.chr((pair % 26 + 65)))
    carry = F.floor(step / 676)
    end = int(prefix[6:8])
    # from the second step on a one-digit result is read with the digit before it
    later = end + (10 * int(prefix[5]) if prefix[5] in "0123456789" else 99) if end < 9 else end
    risen = F.when(carry <= 1, carry + end).otherwise(carry + later)
    head = F.when(carry == 0, F.lit(prefix)).when(
        risen <= 99, F.concat(F.lit(prefix[:6]), risen.cast("string"))).otherwise(
        F.raise_error(F.lit("serial numbers are used up")))
    return F.concat(head, text, digits)


def apply_commands(base: DataFrame, commands: DataFrame, key: str, action: str, value: str, order: Sequence[str]) -> DataFrame:
    """Run create / update / delete / reset commands in order against ``base`` (key, value).

    Gives ``(key, value, reset)``. A create or delete makes earlier commands on
    the key irrelevant; an update or reset of a missing key does nothing.
    """
    at, act = F.struct(*order), F.col(action)
    life = commands.where(act.isin("create", "delete")).groupBy(key).agg(
        F.max_by(action, at).alias("__life"), F.max(at).alias("__since"))
    rest = commands.join(life, key, "left").where(F.col("__since").isNull() | (at >= F.col("__since")))
    ends = rest.groupBy(key).agg(
        F.max("__life").alias("__life"),
        F.max_by(F.struct(value), F.when(act.isin("create", "update"), at)).alias("__new"),
        F.bool_or(act == "reset").alias("__reset"))
    out = base.withColumn("__old", F.lit(True)).join(ends, key, "full_outer")
    alive = F.when(F.col("__life").isNotNull(), F.col("__life") == "create").otherwise(F.coalesce("__old", F.lit(False)))
    return out.where(alive).select(
        key, F.when(F.col("__new").isNotNull(), F.col(f"__new.{value}")).otherwise(F.col(value)).alias(value),
        F.coalesce("__reset", F.lit(False)).alias("reset"))
