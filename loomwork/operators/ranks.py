"""rank, percent_rank, cume_dist and ntile for groups of any size.

Groups up to the limit take Spark's own window. A larger group is cut into
slices along its order (``hot.sliced``): inside a slice the rank and the number of rows up
to a row and its peers are counted by a window, the counts of earlier slices are
carried over, and the peers that lie across the edge of slices - only the first and the
last ones of a slice can - get the smallest rank and the largest count of any of their slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.hot import HOT_ROWS, Sliced, _both, _equal, _name, _small, _staged, sort_columns

RANKS = ("rank", "percent_rank", "cume_dist")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str] = (), ntile: Mapping[str, int] | None = None,
           names: Mapping[str, str] | None = None, rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ranks by ``order`` within ``keys`` (the whole table without any), as SQL gives them.

    ``names`` maps new columns to ``rank``, ``percent_rank`` or ``cume_dist``; ``ntile`` maps new columns to numbers of tiles. Rows that are equal in ``order``
    are peers and share their ranks; ``tie`` puts them in order for the tiles (without it the tile of a peer is open). Columns with a leading ``-`` descend; nulls come
    first ascending and last descending and are peers. A group of one row has a percent_rank of 0.
    """
    names, ntile = dict(names or {}), dict(ntile or {})
    if set(names.values()) - set(RANKS) or any(n < 1 for n in ntile.values()):
        raise ValueError("a rank is one of rank, percent_rank and cume_dist; tiles are at least one")
    keys, order, tie = list(keys), list(order), list(tie)

    def made(rn: Column, rank: Column, upto: Column, n: Column) -> dict[str, Column]:
        out = {}
        for name, kind in names.items():
            out[name] = {"rank": rank.cast("bigint"), "percent_rank": F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0)), "cume_dist": upto / n}[kind]
        for name, tiles in ntile.items():
            small, more = F.floor(n / tiles), n % tiles
            cut = more * (small + 1)
            out[name] = F.when(rn <= cut, F.floor((rn - 1) / (small + 1))).otherwise(more + F.floor((rn - cut - 1) / F.greatest(small, F.lit(1)))).cast("bigint") + 1
        return out

    def plain(part: DataFrame, window) -> DataFrame:
        own = Window.partitionBy(*keys)
        peers = own.orderBy(*sort_columns(order))
        found = made(F.row_number().over(window), F.rank().over(peers), F.count(F.lit(1)).over(peers), F.count(F.lit(1)).over(own))
        return part.select("*", *[c.alias(n) for n, c in found.items()])

    def spread(s: Sliced) -> DataFrame:
        peers = Window.partitionBy(*keys, "__slice").orderBy(*sort_columns(order))
        one = F.count(F.lit(1))
        local = s.df.withColumns({"__rn": F.row_number().over(s.window).cast("bigint"), "__rank": F.rank().over(peers).cast("bigint"),
                                  "__upto": one.over(peers), "__in": F.col("__slice")})
        places = ("__rn", "__rank", "__upto")
        local = _staged(s.carry(local, one, F.sum, lambda before: {c: F.col(c) + F.coalesce(before, F.lit(0)) for c in places}), "ranks")
        # the first and the last peers of each slice
        values = [_name(o) for o in order]
        edge = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)], F.col("__rank").alias("rank"), F.col("__upto").alias("upto"))
        ends = local.groupBy(*keys, "__in").agg(F.min_by(edge, "__rank").alias("a"), F.max_by(edge, "__rank").alias("b"))
        ends = ends.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], F.explode(F.array("a", "b")).alias("e"))
        by = [f"__q{i}" for i in range(len(keys))]
        ends = ends.groupBy(*by, *[F.col(f"e.v{i}").alias(f"__v{i}") for i in range(len(values))]).agg(F.min("e.rank").alias("__r"), F.max("e.upto").alias("__u"))
        totals = local.groupBy(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(keys)]).agg(one.alias("__n"))
        ends, totals = _small(ends, 4 * s.slices), _small(totals, s.slices)
        out = local.join(ends, _equal(local, ends, keys, by) & _equal(local, ends, values, [f"__v{i}" for i in range(len(values))]), "left")
        out = out.join(totals, _equal(local, totals, keys, [f"__t{i}" for i in range(len(keys))]))
        found = made(F.col("__rn"), F.coalesce("__r", "__rank"), F.coalesce("__u", "__upto"), F.col("__n"))
        return out.select(*df.columns, *[c.alias(n) for n, c in found.items()])

    return _both(df, keys, [*order, *tie], rows, plain, spread)
