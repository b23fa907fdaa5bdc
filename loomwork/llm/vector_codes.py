"""Vector compression by codebooks of parts, with distances read from dictionaries of values.

The rows go into blocks, written once: per dimension the block's distinct whole
numbers (its dictionary) and for each row the places in them. In a round the
squared differences of every dictionary value to all entries are tabulated; the
distance of a part to the entries is then a gather from the tables of its
dimensions and an addition. A dictionary has at most as many values as its block
has rows, whatever the numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vectors
from loomwork.llm.common import written

BLOCK_ROWS = 8192
BLOCK_BYTES = 4 << 20

#: Labels whose sums are broadcast.
BROADCAST_LABELS = 100_000


class Block:
    """Rows as dictionary codes."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, codes: np.ndarray, scale: int):
        self.codes = codes
        self.values = np.split(vectors.whole(values, scale), np.cumsum(sizes)[:-1])

    @staticmethod
    def packed(x: np.ndarray, scale: int) -> tuple[np.ndarray, list[int], bytes]:
        """Dictionary values one dimension after the other (over ``scale``: exact as doubles), their numbers, and the codes."""
        # numbers that are too large for a scaled double are whole already
        with np.errstate(over="ignore"):
            f = np.floor(x * scale)
        f = np.where(np.isfinite(f), f / scale, x)
        found = [np.unique(f[:, d], return_inverse=True) for d in range(x.shape[1])]
        codes = np.stack([at for _, at in found], axis=1).astype(np.uint16)
        return np.concatenate([v for v, _ in found]), [len(v) for v, _ in found], codes.tobytes()

    def distances(self, book: np.ndarray, first: int) -> np.ndarray:
        """Squared distances of each row's part, which starts at dimension ``first``, to the entries of ``book``."""
        tables = [(v[:, None] - entry[None, :]) ** 2 for v, entry in zip(self.values[first: first + book.shape[1]], book.T)]
        if all(t.dtype != object for t in tables) and sum(int(t.max(initial=0)) for t in tables) < 1 << 31:
            tables = [t.astype(np.int32) for t in tables]
        out = tables[0][self.codes[:, first]]
        for d in range(1, len(tables)):
            out = out + tables[d][self.codes[:, first + d]]
        return out

    def part_sums(self, entry: np.ndarray, entries: int, first: int, wide: int) -> tuple[np.ndarray, list[list[int]]]:
        """Rows per entry, and per entry the sums of the part's components: how often a dictionary value occurs with an entry, times the value."""
        counts = np.bincount(entry, minlength=entries)
        sums = []
        for d in range(first, first + wide):
            v = self.values[d]
            often = np.bincount(entry * len(v) + self.codes[:, d], minlength=entries * len(v)).reshape(entries, len(v))
            sums.append([int(s) for s in (often.astype(v.dtype) * v[None, :]).sum(axis=1)])
        return counts, [list(s) for s in zip(*sums)]


def coded(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, dim: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding", label_col: str | None = "label", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[list[list[int]]]]:
    """``id, label, code string, error long`` for each vector of ``dim`` finite components, and the final codebooks (part, entry, position).

    Components become floor(scale * x). Vectors are cut into ``parts`` equal parts; the codebook of a part starts as that part of the ``entries`` vectors with the
    smallest ids (null ids last, then by vector; fewer vectors make fewer entries). A round assigns each part to its nearest entry, ties to the lower number, and
    moves each entry to the floor of its parts' mean; an unused one stays. ``code`` has two hex digits a part. Repeated rows and ids count and come back as
    often. Rows with a null vector, with null or non-finite components or of another length are left out; an empty table gives an empty result
    and empty codebooks. Whole numbers of any size are handled exactly; ``error`` is null where it is too large for a long.
    """
    if dim % parts or not 1 <= entries <= 256 or not 1 <= block_rows <= 1 << 16:
        raise ValueError("parts must divide the dimension, and at most 256 entries have two hex digits")
    wide = dim // parts
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col)
    kept = (table.select(F.col(id_col).alias("id"), label.alias("label"), vectors.numbers(table, vector_col).alias("v"))
            .where(vectors.finite("v") & (F.size("v") == dim)))
    starts = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = vectors.whole(np.array([r["v"] for r in starts], np.float64).reshape(len(starts), dim), scale)
    books = [start[:, p * wide: (p + 1) * wide] for p in range(parts)]
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * dim)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        names = ["id", "label", "dictionary", "sizes", "codes"]

        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            x = vectors.matrix(rows.to_batches()[0], dim)
            dictionary, sizes, codes = Block.packed(x, scale)
            one = pa.array([0, len(x)], pa.int32())
            lists = [pa.ListArray.from_arrays(one, rows.column(c).combine_chunks()) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([dictionary], pa.list_(pa.float64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([codes], pa.binary())], names)

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= most:
                rows, at = pa.Table.from_batches(waiting), 0
                while n - at >= most:
                    yield block(rows.slice(at, most))
                    at += most
                waiting, n = pa.Table.from_batches(waiting).slice(at).to_batches(), n - at
        if n:
            yield block(pa.Table.from_batches(waiting))

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    blocks = written(kept.mapInArrow(packed, f"id array<{kinds['id']}>, label array<{kinds['label']}>, dictionary array<double>, sizes array<int>, codes binary"), "vector-blocks")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                codes = np.frombuffer(one.column("codes")[0].as_buffer(), np.uint16).reshape(-1, dim)
                yield one, Block(one.column("dictionary").flatten().to_numpy(), one.column("sizes").flatten().to_numpy(), codes, scale)

    for _ in range(rounds if len(starts) else 0):
        def moved(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[int, list[int]]] = {}
            for _, block in read(batches):
                for p, book in enumerate(books):
                    counts, totals = block.part_sums(block.distances(book, p * wide).argmin(axis=1), len(book), p * wide, wide)
                    for e in np.flatnonzero(counts).tolist():
                        n, old = sums.get(p * entries + e, (0, [0] * wide))
                        sums[p * entries + e] = n + int(counts[e]), [a + b for a, b in zip(old, totals[e])]
            yield vectors.sum_rows(sums)

        totals = vectors.added(blocks.mapInArrow(moved, vectors.SUMS))
        new = []
        for p, book in enumerate(books):
            found = [totals.get(p * entries + e) for e in range(len(book))]
            rows = [[t[k] // t[-1] for k in range(wide)] if t else [int(a) for a in old] for t, old in zip(found, book)]
            new.append(vectors.narrowed(rows, wide))
        books = new

    def last(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
        for row, block in read(batches):
            n = len(block.codes)
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, book in enumerate(books):
                d = block.distances(book, p * wide)
                codes[:, p] = d.argmin(axis=1)
                least = d[np.arange(n), codes[:, p]]
                error = error + (least if least.dtype == object else least.astype(np.int64))
            text = codes.tobytes().hex()
            codes = pa.array([text[2 * parts * k: 2 * parts * (k + 1)] for k in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays([row.column("id").flatten(), row.column("label").flatten(), codes, vectors.longs(error)], ["id", "label", "code", "error"])

    return blocks.mapInArrow(last, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), [[[int(a) for a in e] for e in book] for book in books]


def with_totals(found: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """The rows of ``coded`` with ``label_error``, the sum over equal labels (nulls are equal; null where an error is), and ``codebooks_sha256``."""
    found = written(found, "vector-codes")
    sums = written(found.groupBy("label").agg(vectors.long_sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return (found.join(sums, F.col("label").eqNullSafe(F.col("of")))
            .select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
