"""Work on ordered or collected groups of any size.

A window or a collected list puts one whole group into one task. That is fine
for a small group and fatal for a key that holds a third of a large table. So
every operator here first counts the rows of each key (a narrow scan; the counts
combine before the shuffle):

* no key above the limit: the plain window or grouped aggregate, nothing else;
* keys above the limit: their rows are dealt by range over the keys and all order
  columns, the work runs per key and range partition (a *slice*), and a small table of
  per-slice totals carries the result from one slice to the next. All other rows
  take the plain way.

The counts are exact, so no key above the limit is ever one task. Both ways give the
same rows; only sums of floating numbers may differ in their last digits.

Order columns are written as names; a leading ``-`` means descending. The
order has to be total (end it with a unique column) for repeatable results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import fresh_path

HOT_ROWS = 1_000_000       # a group above this size is never handled by one task
LIST_ROWS = 100_000        # list members put into one row; longer lists go on in further rows
BROADCAST_ROWS = 100_000   # lines of a table of hot keys or slices that are broadcast

_SLICE = "__slice"


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def _name(order: str) -> str:
    return order[1:] if order.startswith("-") else order


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small(df: DataFrame, lines: int) -> DataFrame:
    """Broadcast a table whose lines were counted, up to a bound; beyond it Spark chooses the join."""
    return F.broadcast(df) if lines <= BROADCAST_ROWS else df


def _equal(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str]) -> Column:
    match = F.lit(True)
    for k, n in zip(keys, names):
        match = match & left[k].eqNullSafe(right[n])
    return match


@dataclass
class Crowded:
    """The keys above a limit, as a table, with their number and their rows in all."""

    table: DataFrame
    lines: int
    rows: int

    def split(self, df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(rows of other keys, rows of these keys)"""
        side = _small(self.table, self.lines)
        match = _equal(df, side, keys, [f"__k{i}" for i in range(len(keys))])
        return df.join(side, match, "left_anti"), df.join(side, match, "left_semi")


def crowded(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> Crowded | None:
    """The keys with more than ``rows`` rows, by an exact count; None if there are none."""
    counts = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    found = _staged(counts, "hot-keys")
    total = found.agg(F.count(F.lit(1)), F.sum("__n")).first()
    return Crowded(found, total[0], total[1]) if total[0] else None


@dataclass
class Sliced:
    """Rows in slices along their keys and order, and what carries totals across slices."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    slices: int

    @property
    def window(self):
        return Window.partitionBy(*self.keys, _SLICE).orderBy(*sort_columns(self.order))

    def before(self, total: Column, fold) -> DataFrame:
        """Per key and slice: the totals of all earlier slices of that key, folded.

        A key goes on in a slice only from the one before, so there are at most as many lines as slices and keys.
        """
        names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)]
        sums = self.df.groupBy(*names, F.col(_SLICE).alias("__at")).agg(total.alias("__total"))
        by = [f"__k{i}" for i in range(len(self.keys))]
        earlier = (Window.partitionBy(*by) if by else Window).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*by, "__at", fold("__total").over(earlier).alias("__before"))

    def carry(self, out: DataFrame, total: Column, fold, join) -> DataFrame:
        """Bring the totals of earlier slices in; ``join`` gives the columns to set."""
        side = _small(self.before(total, fold), 2 * self.slices)
        match = (F.col(_SLICE) == F.col("__at")) & _equal(out, side, self.keys, [f"__k{i}" for i in range(len(self.keys))])
        out = out.join(side, match, "left").drop("__at", *[f"__k{i}" for i in range(len(self.keys))])
        return out.withColumns(join(F.col("__before"))).drop("__before", _SLICE)

    def add(self, out: DataFrame, total: Column, name: str) -> DataFrame:
        return self.carry(out, total, F.sum, lambda before: {name: F.col(name) + F.coalesce(before, F.lit(0))})


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, rows: int) -> Sliced:
    """Deal ``count`` rows by range over keys and order, written once so that all later steps see the same slices."""
    slices = max(df.sparkSession.sparkContext.defaultParallelism, -(-count // rows))
    dealt = df.repartitionByRange(slices, *[F.col(k) for k in keys], *sort_columns(order))
    return Sliced(_staged(dealt.withColumn(_SLICE, F.spark_partition_id()), "slices"), list(keys), list(order), slices)


def _both(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, plain, spread) -> DataFrame:
    """``plain(rows, window)`` for small keys, ``spread(slices)`` for those above the limit."""
    keys, order = list(keys), list(order)
    if not keys:  # the whole table is one group, with the same limit
        n = df.count()
        return plain(df, Window.orderBy(*sort_columns(order))) if n <= rows else spread(sliced(df, keys, order, n, rows))
    hot = crowded(df, keys, rows)
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    if hot is None:
        return plain(df, window)
    rest, heavy = hot.split(df, keys)
    return plain(rest, window).unionByName(spread(sliced(heavy, keys, order, hot.rows, rows)))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
             rows: int = HOT_ROWS) -> DataFrame:
    """``row_number()`` from 1 per key (or over the whole table when there is no key)."""
    def plain(part: DataFrame, window) -> DataFrame:
        return part.withColumn(name, F.row_number().over(window).cast("bigint"))

    return _both(df, keys, order, rows, plain, lambda s: s.add(plain(s.df, s.window), F.count(F.lit(1)), name))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str,
                rows: int = HOT_ROWS) -> DataFrame:
    """Sum of ``value`` over this row and all earlier rows of the key."""
    def plain(part: DataFrame, window) -> DataFrame:
        return part.withColumn(name, F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0)))

    return _both(df, keys, order, rows, plain, lambda s: s.add(plain(s.df, s.window), F.sum(value), name))


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                 rows: int = HOT_ROWS) -> DataFrame:
    """Replace a null ``value`` by the last one before it in the key."""
    def plain(part: DataFrame, window) -> DataFrame:
        return part.withColumn(value, F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))

    def spread(s: Sliced) -> DataFrame:
        at = F.struct(*[F.col(_name(o)) for o in order])
        pick = F.min_by if order[0].startswith("-") else F.max_by
        if len({o.startswith("-") for o in order}) > 1:
            raise ValueError("fill_forward needs one direction for all order columns")
        total = pick(F.col(value), F.when(F.col(value).isNotNull(), at))
        return s.carry(plain(s.df, s.window), total, lambda c: F.last(c, ignorenulls=True),
                       lambda before: {value: F.coalesce(F.col(value), before)})

    return _both(df, keys, order, rows, plain, spread)


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int = 0, ahead: int = 0,
            rows: int = HOT_ROWS) -> tuple[DataFrame, Column]:
    """Number the rows, cut each key into blocks, and give each block the rows around it.

    Returns the frame (columns ``rn``, ``__block``, ``__own``) and the window
    for ``lag``/``lead``/short frames. Keep only ``__own`` rows afterwards.
    """
    out = numbered(df, keys, order, "rn", rows)
    at, inner = F.floor((F.col("rn") - 1) / rows), (F.col("rn") - 1) % rows
    homes = [F.array(F.struct(at.alias("b"), F.lit(True).alias("own")))]
    if back:
        homes.append(F.when(inner >= rows - back,
                            F.array(F.struct((at + 1).alias("b"), F.lit(False).alias("own"))))
                     .otherwise(F.array().cast("array<struct<b:bigint,own:boolean>>")))
    if ahead:
        homes.append(F.when((inner < ahead) & (at > 0),
                            F.array(F.struct((at - 1).alias("b"), F.lit(False).alias("own"))))
                     .otherwise(F.array().cast("array<struct<b:bigint,own:boolean>>")))
    out = out.withColumn("__home", F.explode(F.concat(*homes)))
    out = out.withColumn("__block", F.col("__home.b")).withColumn("__own", F.col("__home.own")).drop("__home")
    return out, Window.partitionBy(*keys, "__block").orderBy("rn")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], make, back: int = 0, ahead: int = 0,
               rows: int = HOT_ROWS) -> DataFrame:
    """Add columns ``make(window) -> {name: Column}`` that look a few rows back or ahead."""
    if crowded(df, keys, rows) is None:
        return df.withColumns(make(Window.partitionBy(*keys).orderBy(*sort_columns(order))))
    out, window = blocked(df, keys, order, back, ahead, rows)
    return out.withColumns(make(window)).where("__own").drop("__own", "__block", "rn")


def collect_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                    per_row: int | None = None) -> DataFrame:
    """Group members as arrays in ``order``: ``(key..., part_no, items)``.

    Members ``per_row * p + 1`` to ``per_row * (p + 1)`` of a key are part p, for every key alike, so no row grows with its group.
    """
    per_row = per_row or LIST_ROWS
    names = [_name(o) for o in order]
    rows = df.select(*keys, *[c for c in names if c not in keys], value.alias("__v"))
    rows = numbered(rows, keys, order, "__rn")
    rows = rows.withColumn("part_no", F.floor((F.col("__rn") - 1) / per_row))
    packed = F.sort_array(F.collect_list(F.struct("__rn", "__v")))
    return (rows.groupBy(*keys, "part_no").agg(packed.alias("__l"))
            .select(*keys, "part_no", F.col("__l.__v").alias("items")))


def collect_values(df: DataFrame, keys: Sequence[str], lists: dict[str, bool], more: Sequence[Column] = (),
                   per_row: int | None = None) -> DataFrame:
    """Several sorted lists per key in one pass: ``(key..., part_no, n_rows, <more>..., <column>...)``.

    ``lists`` maps a text column to True for a set, False for a list that keeps
    duplicates; nulls are left out. ``n_rows`` is the row count of the whole
    key; ``more`` adds aggregates of it. Members ``per_row * p + 1`` to ``per_row * (p + 1)`` of each list are part p, for every key
    alike; a key has as many parts as its longest list needs. (Keys of at most ``per_row`` rows need one; they are collected directly.)
    """
    per_row, keys = per_row or LIST_ROWS, list(keys)
    count = F.count(F.lit(1)).alias("n_rows")
    hot = crowded(df, keys, per_row)
    plain, heavy = (df, None) if hot is None else hot.split(df, keys)
    out = plain.groupBy(*keys).agg(
        count, *more, *[F.sort_array(F.collect_set(c) if distinct else F.collect_list(c)).alias(c)
                        for c, distinct in lists.items()])
    facts = [c for c in out.columns if c not in keys and c not in lists]
    out = out.select(*keys, F.lit(0).cast("bigint").alias("part_no"), *facts, *lists)
    if heavy is None:
        return out
    # run lengths: one line per distinct value, so a hot key shrinks before any shuffle
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in lists)
    runs = (heavy.select(*keys, F.expr(f"stack({len(lists)}, {pairs}) as (__c, __v)"))
            .groupBy(*keys, "__c", "__v").agg(F.count(F.lit(1)).alias("__n")))
    totals = heavy.groupBy(*keys).agg(count, *more)  # one line per hot key
    sets = F.array(*[F.lit(c) for c, distinct in lists.items() if distinct]).cast("array<string>")
    runs = (runs.where("__v is not null")
            .withColumn("__n", F.when(F.array_contains(sets, F.col("__c")), F.lit(1)).otherwise(F.col("__n"))))
    runs = running_sum(runs, [*keys, "__c"], ["__v"], "__n", "__end")
    runs = runs.withColumn("__start", F.col("__end") - F.col("__n"))
    runs = runs.withColumn("part_no", F.explode(F.sequence(
        F.floor(F.col("__start") / per_row), F.floor((F.col("__end") - 1) / per_row))))
    length = (F.least("__end", (F.col("part_no") + 1) * per_row)
              - F.greatest("__start", F.col("part_no") * per_row)).cast("int")
    runs = runs.withColumn("__piece", F.struct("__v", length.alias("len")))
    parts = runs.groupBy(*keys, "part_no").agg(*[
        F.flatten(F.transform(
            F.sort_array(F.collect_list(F.when(F.col("__c") == c, F.col("__piece")))),
            lambda p: F.array_repeat(p["__v"], p["len"]))).alias(c) for c in lists])
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *facts)
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & parts[k].eqNullSafe(totals[f"__k{i}"])
    empty = F.array().cast("array<string>")
    parts = totals.join(parts, match, "left").select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)],
        F.coalesce("part_no", F.lit(0)).alias("part_no"), *facts,
        *[F.coalesce(c, empty).alias(c) for c in lists])
    return out.unionByName(parts)
