"""K-means in exact whole numbers, with centroids filtered by an n-simplex projection.

The squared distances of each vector to a few pivots are computed once and kept.
They make the vector the apex of a simplex over the pivots: coordinates in a
space of as many dimensions as pivots. Two apexes give a lower bound (their own
distance) and an upper one (with one altitude turned round) on the distance of
what they stand for. In each round a centroid whose lower bound is above the
smallest upper bound is out; the others are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vectors
from loomwork.llm.common import written

PIVOTS = 8

#: A pivot's altitude over those before it, at least, as a share of the largest distance between pivots: flat simplexes lose digits.
LEAST_ALTITUDE = 0.1

#: Bounds are widened by this share of the numbers they come from, many times the rounding error of a double.
SLACK = 1e-6


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to the vector ``b``."""
    return ((a - b) ** 2).sum(axis=1)


class Simplex:
    """A base of pivots, and the apex coordinates of points known by their squared distances to them."""

    def __init__(self, offered: np.ndarray, most: int = PIVOTS):
        self.pivots = offered[:0]
        self.vertices = np.zeros((0, 0))
        if offered.dtype == object:  # wide numbers are compared without bounds
            return
        span = max((squared(offered, p).max() for p in offered), default=0) ** 0.5
        for p in offered:
            if len(self.pivots) == most:
                break
            if len(self.pivots):
                place = np.append(*self.apex(squared(self.pivots, p).astype(np.float64)[None]))
                if place[-1] <= LEAST_ALTITUDE * span:
                    continue
                self.vertices = np.vstack([np.pad(self.vertices, ((0, 0), (0, 1))), place])
            else:
                self.vertices = np.zeros((1, 0))
            self.pivots = np.vstack([self.pivots, p])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots, one row a point."""
        return np.stack([squared(points, p) for p in self.pivots], axis=1) if len(self.pivots) else np.zeros((len(points), 0), np.int64)

    def apex(self, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates over the base, and altitudes."""
        base = self.vertices[1:]
        right = (d2[:, :1] + (base ** 2).sum(axis=1) - d2[:, 1:]) / 2
        foot = np.linalg.solve(base, right.T).T if len(base) else right
        return foot, np.sqrt(np.maximum(d2[:, 0] - (foot ** 2).sum(axis=1), 0))

    def candidates(self, d2: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
        """For each point the centroids (given by their squared distances, too) that may be the nearest."""
        d2, other = d2.astype(np.float64), of_centroids.astype(np.float64)
        (x, h), (y, g) = self.apex(d2), self.apex(other)
        # |x|^2 + h^2 is the squared distance to the first pivot
        size = d2[:, :1] + other[:, 0]
        flat, high = size - 2 * x @ y.T, 2 * np.outer(h, g)
        lower, upper = flat - high, flat + high
        slack = SLACK * (size + 1)
        return lower - slack <= (upper + slack).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, may: np.ndarray | None, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of equal ones the smaller) and squared distance of each row; without ``exact``, a distance only where there is a choice."""
    wide = x.dtype == object or centroids.dtype == object
    out, best = np.zeros(len(x), np.int64), np.full(len(x), -1, object if wide else np.int64)
    open_ = np.ones(len(x), bool)
    if may is not None and not exact:
        open_ = may.sum(axis=1) > 1
        out = may.argmax(axis=1)
    for c, centre in enumerate(centroids):
        at = np.flatnonzero(open_ if may is None else open_ & may[:, c])
        if len(at):
            d = squared(x[at], centre)
            new = (best[at] < 0) | (d < best[at])
            at = at[new]
            out[at], best[at] = c, d[new]
    return out, best


def _points(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray | None]:
    d2 = batch.column("d2")
    n = len(d2.flatten()) // max(batch.num_rows, 1)
    known = n and d2.null_count == 0
    return vectors.whole(vectors.matrix(batch, dim), scale), d2.flatten().to_numpy().reshape(-1, n) if known else None


def clustered(table: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, first: Column | None = None, id_col: str = "vec_id",
              vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster int, distance long`` for each vector of ``dim`` finite components, and the final centroids.

    Components become floor(scale * x). The centroids start as the ``k`` vectors that come first by ``first`` (default: the id; nulls last, then the vector);
    fewer vectors make fewer centroids. A round assigns each vector to its nearest centroid, ties to the smaller number, and moves each centroid to the floor
    of its vectors' mean; one without vectors stays. Repeated rows and ids count and come back as often, null ids too. Other rows are left out; an empty table gives an
    empty result and no centroids. Whole numbers of any size are handled exactly; ``distance`` is null where it is too large for a long.
    """
    order = F.col(id_col) if first is None else first
    kept = (table.select(F.col(id_col).alias("id"), vectors.numbers(table, vector_col).alias("v"), order.alias("o"))
            .where(vectors.finite("v") & (F.size("v") == dim)))
    starts = kept.select("o", "v").orderBy(F.col("o").asc_nulls_last(), "v").limit(k).collect()
    start = np.array([r["v"] for r in starts], np.float64).reshape(len(starts), dim)
    centroids = vectors.whole(start, scale)
    simplex = Simplex(centroids)

    def with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.whole(vectors.matrix(batch, dim), scale)
            d2 = [None] * len(x) if x.dtype == object else simplex.distances(x).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(d2, pa.list_(pa.int64()))], ["id", "v", "d2"])

    kind = kept.schema["id"].dataType.simpleString()
    cached = written(kept.select("id", "v").mapInArrow(with_distances, f"id {kind}, v {kept.schema['v'].dataType.simpleString()}, d2 array<long>"), "pivot-distances")

    def assigned(batch, centres, of_centres, exact):
        x, d2 = _points(batch, dim, scale)
        return x, *nearest(x, centres, simplex.candidates(d2, of_centres) if d2 is not None and of_centres is not None else None, exact)

    def bounds(centres):
        return simplex.distances(centres) if len(simplex.pivots) and centres.dtype != object else None

    for _ in range(rounds if len(starts) else 0):
        def moved(batches: Iterator[pa.RecordBatch], centres=centroids, of_centres=bounds(centroids)) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[int, list[int]]] = {}
            for batch in batches:
                x, c, _ = assigned(batch, centres, of_centres, False)
                for s in np.unique(c).tolist():
                    own = x[c == s]
                    n, total = sums.get(s, (0, [0] * dim))
                    sums[s] = n + len(own), [a + int(b) for a, b in zip(total, own.sum(axis=0))]
            yield vectors.sum_rows(sums)

        totals = vectors.added(cached.mapInArrow(moved, vectors.SUMS))
        rows = [[totals[c][p] // totals[c][-1] for p in range(dim)] if c in totals else [int(a) for a in old] for c, old in enumerate(centroids)]
        centroids = vectors.narrowed(rows, dim)

    def last(batches: Iterator[pa.RecordBatch], centres=centroids, of_centres=bounds(centroids)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, c, d = assigned(batch, centres, of_centres, True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(c, pa.int32()), vectors.longs(d)], ["id", "cluster", "distance"])

    return cached.mapInArrow(last, f"id {kind}, cluster int, distance long"), [[int(a) for a in c] for c in centroids]


def with_totals(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The rows of ``clustered`` with ``cluster_inertia``, ``inertia`` (null where a distance is null or the sum too large for a long) and ``centroid_sha256``."""
    spark = found.sparkSession
    found = written(found, "clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(vectors.long_sum("distance").alias("s")).collect()}  # at most k lines
    whole = None if None in sums.values() or sum(sums.values()) >= 1 << 63 else sum(sums.values())
    rows = [(c, s, whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
