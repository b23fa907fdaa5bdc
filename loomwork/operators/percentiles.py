"""Exact percentiles for groups of any size.

Groups up to the limit are numbered by a window. A larger group is narrowed in
rounds: a quantile sketch gives edges, the rows between (and on) the edges are
counted exactly, which combines before the shuffle, and the count that covers a wanted
rank names the range to go on with. A rank that falls on an edge is found; a
range that is small enough is numbered. With 255 edges a round leaves about a
hundredth of a group, so two or three rounds do for any size, and no group ever
lies in one task. The sketch only steers: ranks come from the counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.bins import edges_up_to
from loomwork.operators.hot import HOT_ROWS, _equal, _small, _staged, numbered

EDGES = 255
ACCURACY = 2048


def _rank(n: Column, share: float, cont: bool) -> tuple[Column, Column, Column]:
    """The two ranks (from 0) that a percentile lies between, and how far it is from the first to the second."""
    if not cont:
        at = F.greatest(n - F.floor(n - n * F.lit(share)), F.lit(1)).cast("long") - 1
        return at, at, F.lit(0.0)
    at = (n - 1) * F.lit(share)
    return F.floor(at).cast("long"), F.ceil(at).cast("long"), at - F.floor(at)


def _narrowed(values: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """``g, r, value``: the value with each wanted rank ``r`` (from 0) of group ``g``; values: ``g, v``."""
    found = []
    # a target keeps the group and rank it was asked for
    targets = targets.select("g", F.col("g").alias("g0"), F.col("r").alias("r0"), "r", F.lit(None).cast("long").alias("size"))
    while True:
        shares = ", ".join(f"{k / (EDGES + 1)!r}D" for k in range(1, EDGES + 1))
        edges = values.groupBy("g").agg(F.array_sort(F.array_distinct(F.expr(f"percentile_approx(v, array({shares}), {ACCURACY})"))).alias("e"))
        edges = _staged(edges, "edges")
        lines = edges.count()
        placed = values.join(_small(edges, lines), "g").withColumn("p", edges_up_to(F.col("v"), F.col("e"), EDGES))
        # even: between two edges; odd: on one
        on = F.coalesce(F.get("e", F.col("p") - 1) == F.col("v"), F.lit(False))
        placed = placed.withColumn("b", 2 * F.col("p") - on.cast("int"))
        counts = _staged(placed.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")), "edge-counts")
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("b"))  # at most 2 * EDGES + 1 lines a group
        ranges = counts.select("g", "b", "n", (upto - F.col("n")).alias("start"))
        hits = targets.join(ranges, "g").where("r >= start and r < start + n")
        hits = _staged(hits.join(edges, "g").select(
            "g", "g0", "r0", (F.col("r") - F.col("start")).alias("r"), "b", "n", "size",
            F.when(F.col("b") % 2 == 1, F.get("e", F.floor(F.col("b") / 2).cast("int"))).alias("value")), "ranks")
        found.append(hits.where("b % 2 = 1").select("g0", "r0", "value"))
        # a range goes on under a number of its own; where a round changed nothing (numbers that the sketch rounds), numbering ends it
        left = hits.where("b % 2 = 0").groupBy("g", "b").agg(F.max("n").alias("n"), F.max("size").alias("size"))
        left = _staged(left.select(F.monotonically_increasing_id().alias("to"), "*", (F.col("n") > rows).alias("large")), "ranges")
        total = left.agg(F.count(F.lit(1)), F.count(F.when(F.col("large") & (F.col("n") < F.coalesce("size", F.col("n") + 1)), 1))).first()
        if total[0] == 0:
            break
        values = _staged(placed.join(_small(left.select("g", "b", "to"), total[0]), ["g", "b"]).select(F.col("to").alias("g"), "v"), "values")
        targets = _staged(hits.where("b % 2 = 0").drop("size").join(left.select("g", "b", "to", F.col("n").alias("size"), "large"), ["g", "b"])
                          .select(F.col("to").alias("g"), "g0", "r0", "r", "size", "large"), "targets")
        if total[1] == 0:
            break
        small = targets.where("not large")
        found.append(_picked(values.join(left.where("not large").select(F.col("to").alias("g")), "g", "left_semi"), small, rows))
        values = values.join(left.where("large").select(F.col("to").alias("g")), "g", "left_semi")
        targets = targets.where("large").drop("large")
    if total[0]:
        found.append(_picked(values, targets, rows))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _staged(out.select(F.col("g0").alias("g"), F.col("r0").alias("r"), "value"), "percentiles")


def _picked(values: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    ranked = numbered(values, ["g"], ["v"], "rn", rows).select("g", (F.col("rn") - 1).alias("r"), F.col("v").alias("value"))
    return targets.select("g", "r", "g0", "r0").join(ranked, ["g", "r"]).select("g0", "r0", "value")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], cont: bool = False, rows: int = HOT_ROWS) -> DataFrame:
    """``key..., n, <name>...``: per key the number of values and the percentile at each share (0 to 1).

    ``cont`` interpolates between neighbours (a double), else a percentile is a value of the group, the first whose share of the rows reaches it, in the column's
    own type (a number, date or timestamp). Null values do not count; a key with none has no row. Null keys are a key. Without keys the whole table is one group.
    """
    if not shares or not all(0 <= s <= 1 for s in shares.values()):
        raise ValueError("shares lie between 0 and 1")
    keys = list(keys)
    data = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("v")).where("v is not null")
    names = [f"__k{i}" for i in range(len(keys))]
    ends = {name: _rank(F.col("n"), share, cont) for name, share in shares.items()}
    counts = _staged(data.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "group-counts")
    large = counts.where(F.col("n") > rows).select(F.monotonically_increasing_id().alias("g"), "*")
    large = _staged(large, "large-groups")
    n_large = large.count()

    def finished(found: DataFrame) -> DataFrame:
        out = []
        for i, (name, (_, _, part)) in enumerate(ends.items()):
            low, high = F.col(f"__a{i}"), F.col(f"__b{i}")
            out.append((low if not cont else low.cast("double") * (1 - part) + high.cast("double") * part).alias(name))
        return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", *out)

    def picks(rank: Column, of: Column) -> list[Column]:
        return [F.max(F.when(rank == r, of)).alias(f"__{c}{i}") for i, (low, high, _) in enumerate(ends.values()) for c, r in (("a", low), ("b", high))]

    rest = data
    if n_large:
        side = _small(large, n_large).withColumnsRenamed({n: f"{n}_" for n in names})
        rest = data.join(side, _equal(data, side, names, [f"{n}_" for n in names]), "left_anti")
    own = Window.partitionBy(*names)
    small = (rest.withColumns({"rn": F.row_number().over(own.orderBy("v")) - 1, "n": F.count(F.lit(1)).over(own)})
             .groupBy(*names, "n").agg(*picks(F.col("rn"), F.col("v"))))
    if not n_large:
        return finished(small)
    wanted = F.array_distinct(F.array(*[r for low, high, _ in ends.values() for r in (low, high)]))
    targets = _staged(large.select("g", F.explode(wanted).alias("r")), "targets")
    values = data.join(side, _equal(data, side, names, [f"{n}_" for n in names])).select("g", "v")
    found = large.join(_narrowed(values, targets, rows), "g").groupBy("g", *names, "n").agg(*picks(F.col("r"), F.col("value")))
    return finished(small).unionByName(finished(found))
