"""Near-duplicate vectors by an epsilon grid order join.

A cosine of at least t between unit vectors is a distance of at most
epsilon = sqrt(2 - 2 t). The distinct vectors are turned to unit length and
sorted by their grid cells of width epsilon on the leading principal dimensions.
The sorted sequence is cut into blocks. Pairs of sequence intervals are joined
from the whole sequence downwards, first as rows of a table (down to pairs of
blocks), then inside the task that holds a pair of blocks (down to leaves of a
few rows): an interval pair whose bounding boxes on these dimensions are further
apart than epsilon is dropped with all below it. A projection never makes a
distance longer, so nothing is lost, whatever the dimensions are fitted on.

A task gives, for a pair of blocks, how many links each vector has and edges
that join what is linked; pairs of a dense group are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vectors
from loomwork.llm.common import written
from loomwork.llm.simhash import components

BLOCK_ROWS = 16384
BLOCK_BYTES = 8 << 20
LEAF_ROWS = 64
#: Leading principal dimensions, and vectors that they are fitted on (their choice changes the speed, never the result).
DIMS = 16
FIT_ROWS = 4096
#: Range partitions of the sorted sequence at most.
PARTITIONS = 20_000
#: Copies of a block at most that are sent to spread its pairs over tasks.
MOST_SALTS = 16
#: Boxes are widened by this much, many times the rounding error of a unit vector.
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled by their largest component first, so that no square runs over or under."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def principal(sample: np.ndarray, dims: int) -> np.ndarray:
    """The leading principal directions of unit vectors, as columns."""
    return np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)[2][:dims].T


def _apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared distance of boxes, row by row."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return (gap * gap).sum(axis=1)


class Sequence:
    """The vectors of a block in grid order, with the boxes of their intervals: leaves, then two of the level below each."""

    def __init__(self, x: np.ndarray, basis: np.ndarray | None, dims: int):
        self.x, self.unit = x, units(x)
        place = projected(self.unit, basis, dims)
        starts = np.arange(0, len(x), LEAF_ROWS)
        self.boxes = [(np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts))]
        while len(self.boxes[-1][0]) > 1:
            low, high = self.boxes[-1]
            if len(low) % 2:  # an interval without rows is infinitely far from all
                low, high = np.vstack([low, np.full_like(low[:1], np.inf)]), np.vstack([high, np.full_like(high[:1], -np.inf)])
                self.boxes[-1] = low, high
            self.boxes.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))

    def box(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.boxes[min(level, len(self.boxes) - 1)]
        inside = at < len(low)
        low, high = low[np.minimum(at, len(low) - 1)], high[np.minimum(at, len(low) - 1)]
        return np.where(inside[:, None], low, np.inf), np.where(inside[:, None], high, -np.inf)


def near_leaves(a: Sequence, b: Sequence, same: bool, eps2: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold vectors within epsilon, by recursive halving of both sequences, a level at a time."""
    top = max(len(a.boxes), len(b.boxes)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        if level < top:
            i, j = (np.repeat(2 * i, 4) + np.tile([0, 0, 1, 1], len(i)), np.repeat(2 * j, 4) + np.tile([0, 1, 0, 1], len(j)))
        if same:
            i, j = i[i <= j], j[i <= j]
        near = _apart(*a.box(level, i), *b.box(level, j)) <= eps2 + SLACK
        i, j = i[near], j[near]
    order = np.lexsort((j, i))
    return i[order], j[order]


def _union(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the groups of u[k] and v[k]; a root is the smallest place of its group."""
    while True:
        x, y = root[u], root[v]
        open_ = x != y
        if not open_.any():
            return
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def joined(a: Sequence, b: Sequence, of_a: np.ndarray, of_b: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two blocks (or one with itself): links of each vector, in all copies (``of_a``, ``of_b``) of the others, and roots of what is linked.

    The places of ``b`` follow those of ``a``; if both are the same they are the same places.
    """
    shift = 0 if same else len(a.x)
    count_a, count_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    root = np.arange(len(a.x) + (0 if same else len(b.x)))
    i, j = near_leaves(a, b, same, 2 - 2 * least)
    cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
    for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)]):
        own = np.arange(i[start] * LEAF_ROWS, min((i[start] + 1) * LEAF_ROWS, len(a.x)))
        other = (j[start:stop, None] * LEAF_ROWS + np.arange(LEAF_ROWS)).ravel()
        other = other[other < len(b.x)]
        near = a.unit[own] @ b.unit[other].T
        r, c = np.nonzero(near >= least - SLACK)
        if same:
            r, c = (k[other[c] > own[r]] for k in (r, c))
        if not len(r):
            continue
        # so near the limit the sum of products in another order counts: take the plain formula
        edge = np.flatnonzero(np.abs(near[r, c] - least) <= SLACK)
        ok = np.ones(len(r), bool)
        ok[edge] = cosine(a.x[own[r[edge]]], b.x[other[c[edge]]]) >= least
        u, v = own[r[ok]], other[c[ok]]
        np.add.at(count_a, u, of_b[v])
        np.add.at(count_a if same else count_b, v, of_a[u])
        _union(root, u, v + shift)
    return count_a, count_b, root


def projected(unit: np.ndarray, basis: np.ndarray | None, dims: int) -> np.ndarray:
    """Unit vectors on the leading dimensions: of the basis, or the first ones where the basis is for another length."""
    place = unit @ basis if basis is not None and len(basis) == unit.shape[1] else unit[:, :dims]
    return np.pad(place, ((0, 0), (0, dims - place.shape[1])))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Runs of rows whose vectors have one length."""
    size = np.asarray(batch.column("v").value_lengths())
    cuts = np.flatnonzero(np.append(True, size[1:] != size[:-1])).tolist() if batch.num_rows else []
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(a, b - a), int(size[a])


def _cells(basis: np.ndarray | None, dims: int, eps: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, size in _by_length(batch):
                place = projected(units(vectors.matrix(rows, size)), basis, dims)
                lists = [pa.array(list(np.floor(place / max(eps, 1e-3)).astype(np.int32)), pa.list_(pa.int32())), pa.array(list(place), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *lists], [*rows.schema.names, "cell", "place"])

    return work


def _blocks(dims: int, most_rows: int):
    """Sorted rows as blocks: number in the partition, length, packed vectors, nodes and copies, and the bounding box."""
    names = ["block", "size", "data", "nodes", "copies", "low", "high"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, rows_waiting, now = 0, [], 0, -1
        base = TaskContext.get().partitionId() << 32

        def block(tab: pa.Table) -> pa.RecordBatch:
            nonlocal number
            rows = tab.combine_chunks().to_batches()[0]
            x = rows.column("v").flatten().to_numpy(zero_copy_only=False)
            place = np.array(rows.column("place").flatten()).reshape(-1, dims)
            out = [base + number, now, x.astype(np.float64 if x.dtype == np.float64 else np.float32).tobytes(), np.asarray(rows.column("node")), np.asarray(rows.column("copies")), place.min(axis=0), place.max(axis=0)]
            number += 1
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([o], k) for o, k in zip(out, kinds)], names)

        for batch in batches:
            for rows, size in _by_length(batch):
                if size != now and rows_waiting:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, rows_waiting = [], 0
                now, at = size, 0
                most = max(1, min(most_rows, BLOCK_BYTES // (8 * size)))
                while at < rows.num_rows:
                    take = min(most - rows_waiting, rows.num_rows - at)
                    waiting.append(rows.slice(at, take))
                    rows_waiting, at = rows_waiting + take, at + take
                    if rows_waiting == most:
                        yield block(pa.Table.from_batches(waiting))
                        waiting, rows_waiting = [], 0
        if rows_waiting:
            yield block(pa.Table.from_batches(waiting))

    return work


def near_blocks(boxes: DataFrame, dims: int, eps2: float, bits: int, step: int = 4) -> DataFrame:
    """``a, b`` with a <= b: pairs of blocks whose boxes are within epsilon, from the whole sequence down by ``2 ** step`` intervals in each at a time.

    boxes: ``at`` (place in the sequence, below ``2 ** bits``), ``l0, h0, l1, ...``; l0 is the vectors' length, which keeps lengths apart.
    """
    levels = max(1, -(-bits // step))
    edges = [c for d in range(dims + 1) for c in (F.min(f"l{d}").alias(f"l{d}"), F.max(f"h{d}").alias(f"h{d}"))]
    # the whole sequence (not as a literal: the joins below shall stay joins on equal numbers)
    pairs = boxes.select(F.shiftright("at", step * levels).alias("a")).distinct().select("a", F.col("a").alias("b"))
    for level in range(levels - 1, -1, -1):
        part = boxes.groupBy(F.shiftright("at", step * level).alias("i")).agg(*edges) if level else boxes.withColumnRenamed("at", "i")
        part = part.withColumn("of", F.shiftright("i", step))
        x, y = (part.select(*[F.col(c).alias(f"{side}{c}") for c in part.columns]) for side in "xy")
        apart = F.lit(0.0)
        for d in range(dims + 1):
            gap = F.greatest(F.col(f"xl{d}") - F.col(f"yh{d}"), F.col(f"yl{d}") - F.col(f"xh{d}"), F.lit(0.0))
            apart = apart + gap * gap
        pairs = (pairs.join(x, F.col("a") == F.col("xof")).join(y, F.col("b") == F.col("yof"))
                 .where((F.col("xi") <= F.col("yi")) & (apart <= eps2 + SLACK)).select(F.col("xi").alias("a"), F.col("yi").alias("b")))
        if level % 3 == 2:  # a plan of a few levels at a time
            pairs = written(pairs, "interval-pairs")
    return pairs


def _linked(basis: np.ndarray | None, dims: int, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in batch.schema.names}
                same, size = one["a"].as_py() == one["b"].as_py(), one["size"].as_py()

                def side(k, one=one, size=size):
                    nodes, copies = (np.asarray(one[f"{c}_{k}"].values) for c in ("nodes", "copies"))
                    raw = one[f"data_{k}"].as_buffer()
                    x = np.frombuffer(raw, np.float64 if raw.size == 8 * size * len(nodes) else np.float32).reshape(-1, size).astype(np.float64)
                    return Sequence(x, basis, dims), nodes, copies

                a, nodes_a, of_a = side("a")
                b, nodes_b, of_b = (a, nodes_a, of_a) if same else side("b")
                count_a, count_b, root = joined(a, b, of_a, of_b, same, least)
                nodes, counts = (nodes_a, count_a) if same else (np.append(nodes_a, nodes_b), np.append(count_a, count_b))
                some, tied = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
                for at in range(0, len(some) + len(tied), 1 << 16):
                    s, t = some[at: at + (1 << 16)], tied[max(at - len(some), 0): max(at + (1 << 16) - len(some), 0)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.append(nodes[s], nodes[t])), pa.array([None] * len(s) + nodes[root[t]].tolist(), pa.int64()),
                         pa.array(counts[s].tolist() + [None] * len(t), pa.int64())], ["u", "v", "n"])

    return work


def near_vectors(table: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, n_links long, component`` for each row: how many other rows have a cosine of at least ``least`` (0 < least <= 1) with it, and the smallest id linked to it over any number of steps.

    Equal vectors are one point with a number of copies; each copy links with the others. Null, empty and zero vectors and those with null or non-finite components link with
    nothing, nor do vectors of different lengths; they have 0 links and are their own component. Null ids count as rows, but name a component only where it has no other
    (then null). Repeated rows and ids come back as often. An empty table gives an empty result; further columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine lies above 0 and at most at 1")
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), vectors.numbers(table, vector_col).alias("v"))
    ok = vectors.finite("v") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(ok, F.col("v")))
    points = written(rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
                     .select(F.monotonically_increasing_id().alias("node"), "*"), "points")
    n = points.count()

    sample = [np.array(r["v"], np.float64) for r in points.orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS).select("v").collect()]
    basis = None
    if sample:
        sizes = [len(v) for v in sample]
        main = max(set(sizes), key=lambda s: (sizes.count(s), s))
        basis = principal(units(np.stack([v for v in sample if len(v) == main])), min(dims, main))
        basis = np.pad(basis, ((0, 0), (0, dims - basis.shape[1])))
    eps2 = 2 - 2 * least

    kind = rows.schema["v"].dataType.simpleString()
    placed = points.select("node", "copies", "v").mapInArrow(_cells(basis, dims, eps2 ** 0.5), f"node long, copies long, v {kind}, cell array<int>, place array<double>")
    parts = max(1, min(PARTITIONS, -(-n // (2 * block_rows))))
    order = [F.size("v"), "cell", "place", "node"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = written(ordered.select("node", "copies", "v", "place").mapInArrow(
        _blocks(dims, block_rows), "block long, size int, data binary, nodes array<long>, copies array<long>, low array<double>, high array<double>"), "vector-blocks")

    # places in the sequence: partition, then block in it
    last = blocks.agg(F.max(F.shiftright("block", 32)), F.max(F.col("block").bitwiseAND((1 << 32) - 1))).first()
    inner = int(last[1] or 0).bit_length()
    at = F.shiftleft(F.shiftright("block", 32), inner) + F.col("block").bitwiseAND((1 << 32) - 1)
    blocks = blocks.withColumn("at", at)
    edges = [(F.col("size") * 10.0).alias("l0"), (F.col("size") * 10.0).alias("h0")]
    edges += [F.col(c)[d].alias(f"{c[0]}{d + 1}") for d in range(dims) for c in ("low", "high")]
    pairs = written(near_blocks(blocks.select("at", *edges), dims, eps2, int(last[0] or 0).bit_length() + inner), "block-pairs")

    # a pair is a row with both blocks in it. The first block of each pair travels once, the second once for each of its salts; few blocks get several, so that all cores work
    n_blocks, cores = max(blocks.count(), 1), spark.sparkContext.defaultParallelism
    salts = max(1, min(MOST_SALTS, -(-3 * cores // n_blocks)))
    tasks = max(1, min(PARTITIONS, n_blocks * salts))
    a, b = (blocks.select(F.col("at").alias(k), *([F.col("size")] if k == "a" else []), *[F.col(c).alias(f"{c}_{k}") for c in ("data", "nodes", "copies")]) for k in "ab")
    a = pairs.join(a, "a").withColumn("salt", F.pmod("a", F.lit(salts)).cast("int")).repartition(tasks, "b", "salt")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(tasks, "b", "salt")
    found = written(a.join(b, ["b", "salt"]).mapInArrow(_linked(basis, dims, least), "u long, v long, n long"), "vector-links")

    counts = found.where("n is not null").groupBy(F.col("u").alias("c")).agg(F.sum("n").alias("n"))
    roots = components(found.where("v is not null").select("u", "v"))
    nodes = (points.join(counts, F.col("node") == F.col("c"), "left").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
             .select("v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    nodes = written(nodes, "point-links")
    named = nodes.groupBy("root").agg(F.min("least").alias("component"))
    nodes = nodes.join(named, "root").select(F.col("v").alias("w"), "n_links", "component")
    out = rows.join(nodes, F.col("v") == F.col("w"), "left")
    alone = F.col("v").isNull()
    return out.select("id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                      F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"))
