"""As-of join: each row with the one row of another table that is nearest to it in time.

Both sides go into one sequence per key, ordered by time, and each left row takes
the last right row before it (``hot.fill_forward``). No pair of rows is ever
built: the work is one shuffle by key and one sort. A key above the limit is cut
into time slices, and the last right row of a slice is carried over its edge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.hot import HOT_ROWS, fill_forward


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str | tuple[str, str]], left_time: str, right_time: str,
              take: Sequence[str] | Mapping[str, str], direction: str = "backward", tolerance: Column | None = None, exact: bool = True,
              tie: Sequence[str] = (), rows: int = HOT_ROWS) -> DataFrame:
    """All rows and columns of ``left`` once, with the columns ``take`` of the matched row of ``right`` (null without one).

    keys: names, or (left, right) pairs of names; equal values match, null matches nothing. ``take`` maps new names to columns of ``right``, or lists columns
    under their own names; none may be a column of ``left``. ``direction`` is ``backward`` (the last right row at or before the left time),
    ``forward`` (the first at or after) or ``nearest`` (the closer of the two, the earlier if both are equally far). ``exact=False`` leaves out right rows
    of the same time. ``tolerance`` is the largest time difference that still matches: an interval for timestamps, a number for numbers.
    Of right rows with the same key and time the one with the largest ``tie`` columns counts backward, that with the smallest forward; without ``tie`` any one.
    Rows without a time match nothing. Repeated rows come back as often as they are in ``left``; empty tables are fine.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no direction {direction}")
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    taken = dict(take) if isinstance(take, Mapping) else {c: c for c in take}
    if {c.lower() for c in taken} & {c.lower() for c in left.columns}:
        raise ValueError("a column to take has the name of a left column; give it another")
    names, ties = [f"__on{i}" for i in range(len(pairs))], [f"__y{i}" for i in range(len(tie))]
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    match = F.struct(F.col(right_time).alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(taken.values())])
    here = F.col(left_time).isNotNull()
    for a, _ in pairs:
        here = here & F.col(a).isNotNull()
    there = F.col(right_time).isNotNull()
    for _, b in pairs:
        there = there & F.col(b).isNotNull()
    # right rows come first in the direction of the walk if the same time counts
    backward, forward = (0, 1) if exact else (1, 0)
    r = right.where(there).select(
        *[F.col(b).alias(n) for (_, b), n in zip(pairs, names)], F.col(right_time).alias("__t"), *[F.col(c).alias(n) for c, n in zip(tie, ties)],
        F.lit(backward).alias("__sb"), F.lit(forward).alias("__sf"), F.lit(0).cast("long").alias("__h"), match.alias("__b"))
    kinds = {f.name: f.dataType for f in r.schema.fields}
    r = r.withColumn("__l", F.lit(None).cast(left.select(whole.alias("w")).schema["w"].dataType))
    entry = left.select(
        *[F.col(a).alias(n) for (a, _), n in zip(pairs, names)], F.col(left_time).alias("__t"), *[F.lit(None).cast(kinds[n]).alias(n) for n in ties],
        F.lit(1 - backward).alias("__sb"), F.lit(1 - forward).alias("__sf"), F.xxhash64(whole).alias("__h"), F.lit(None).cast(kinds["__b"]).alias("__b"),
        whole.alias("__l"), here.alias("__here"))
    line = r.withColumn("__here", F.lit(True)).unionByName(entry.where("__here"))
    alone = entry.where(~F.col("__here"))
    # the hash only spreads left rows of one time over slices
    if direction == "nearest":
        line = line.withColumn("__f", F.col("__b"))
        line = fill_forward(line, names, ["__t", "__sb", *ties, "__h"], "__b", rows)
        line = fill_forward(line, names, ["-__t", "-__sf", *[f"-{y}" for y in ties], "-__h"], "__f", rows)
        alone = alone.withColumn("__f", F.col("__b"))
    elif direction == "backward":
        line = fill_forward(line, names, ["__t", "__sb", *ties, "__h"], "__b", rows)
    else:
        line = fill_forward(line, names, ["-__t", "-__sf", *[f"-{y}" for y in ties], "-__h"], "__b", rows)
    line = line.where("__l is not null").unionByName(alone)
    before, after = F.col("__t") - F.col("__b.t"), F.col("__b.t") - F.col("__t")
    if direction == "nearest":
        further = F.col("__f.t") - F.col("__t")
        later = F.col("__b").isNull() | (F.col("__f").isNotNull() & (further < before))
        line = line.withColumn("__b", F.when(later, F.col("__f")).otherwise(F.col("__b")))
    if tolerance is not None:
        ok = {"backward": before <= tolerance, "forward": after <= tolerance, "nearest": (before <= tolerance) & (after <= tolerance)}[direction]
        line = line.withColumn("__b", F.when(ok, F.col("__b")))
    return line.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__b.c{i}").alias(n) for i, n in enumerate(taken)])
