"""SimHash near-duplicates by covering codes.

Anchors are the words of a covering code. A 64-bit fingerprint is two halves of
32 bits; of fingerprints that differ in at most 5 bits, one half differs in at
most 2. A half is 23 bits in the binary Golay code, whose covering radius is 3
(each 23-bit word is within 3 bits of exactly one code word), and 9 bits as they are.
Two halves that differ in 2 bits have a half between them, 1 bit from either; the
anchor that covers it lies within radius + 1 of both. So each fingerprint is
copied to all anchors within covering radius plus 1 of each half (about 29), and any two
linked ones meet at an anchor, where they are compared. Nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import free_names, slices, texts_of, written
from loomwork.llm.line_dedup import row_keys

#: Fingerprints at one anchor that one task compares; more are compared block by block.
TASK_PRINTS = 16384
#: Crowded anchors up to which their table (16 bytes each) is broadcast.
BROADCAST_ANCHORS = 1 << 17

GOLAY = 0b101011100011  # the generator polynomial of the [23, 12, 7] code


def fingerprint(text: bytes, words: int = 4) -> int:
    """The SimHash of a text: words between ASCII white space, A-Z in lower case, shingles with repeats."""
    parts = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id long, k1, k2, print long`` for each row; a null text counts as empty, whose fingerprint is zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k1"), batch.column("k2"), pa.array(prints)], ["id", "k1", "k2", "print"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", "text", *row_keys(F.col("id"), F.col("text")))
            .mapInArrow(work, "id long, k1 long, k2 long, print long"))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator polynomial."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= np.where((left >> bit) & 1, GOLAY << (bit - 11), 0)
    return left


@lru_cache(maxsize=1)
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the pattern of at most 3 bits, and those of 4 bits (padded with -1)."""
    errors = {w: np.array([sum(1 << b for b in c) for c in combinations(range(23), w)], np.int64) for w in range(5)}
    near = np.zeros(2048, np.int64)
    for w in range(4):
        near[_syndromes(errors[w])] = errors[w]
    of = _syndromes(errors[4])
    order = np.argsort(of, kind="stable")
    place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    far = np.full((2048, place.max() + 1), -1, np.int64)
    far[of[order], place] = errors[4][order]
    return near, far


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, anchor) for all anchors within covering radius plus 1 of a half."""
    near, far = _patterns()
    rows, keys = [], []
    at = np.arange(len(prints))
    for half in (0, 1):
        x = ((prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        plain, coded = x & 511, x >> 9
        s = _syndromes(coded)

        def add(row, word, rest):
            rows.append(row)
            keys.append((half << 32) | (word << 9) | rest)

        nearest = coded ^ near[s]
        add(at, nearest, plain)
        for k in range(far.shape[1]):
            has = far[s, k] >= 0
            add(at[has], coded[has] ^ far[s[has], k], plain[has])
        for bit in range(9):
            add(at, nearest, plain ^ (1 << bit))
    return np.concatenate(rows), np.concatenate(keys)


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def spanning_links(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what any links join: from a found print to prints not reached before."""
    left, right, rest = [], [], prints
    while len(rest):
        queue, rest = rest[:1], rest[1:]
        while len(queue) and len(rest):
            front, queue = queue[:64], queue[64:]
            near = _close(front[:, None], rest[None, :], bits)
            hit = near.any(axis=0)
            left.append(front[near[:, hit].argmax(axis=0)])
            right.append(rest[hit])
            queue, rest = np.append(queue, rest[hit]), rest[~hit]
    return np.concatenate([prints[:0], *left]), np.concatenate([prints[:0], *right])


def _links(bits: int):
    """Rows sorted by group in; links within the groups out."""
    small = 24

    def of_groups(group: np.ndarray, prints: np.ndarray):
        bounds = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
        size = np.diff(np.append(bounds, len(prints)))
        left, right = [], []
        number = np.repeat(np.arange(len(size)), size)
        few = (size[number] > 1) & (size[number] <= small)
        a, g = prints[few], number[few]
        for lag in range(1, small):
            if len(a) <= lag:
                break
            ok = (g[lag:] == g[:-lag]) & _close(a[lag:], a[:-lag], bits)
            left.append(a[:-lag][ok])
            right.append(a[lag:][ok])
        for k in np.flatnonzero(size > small).tolist():
            x, y = spanning_links(prints[bounds[k]: bounds[k] + size[k]], bits)
            left.append(x)
            right.append(y)
        empty = prints[:0]
        x, y = np.concatenate([empty, *left]), np.concatenate([empty, *right])
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, prints = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            more = np.stack([batch.column(c).to_numpy() for c in ("anchor", "a", "b")], axis=1)
            group, prints = np.concatenate([group, more]), np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
            last = len(prints) - int((group == group[-1]).all(axis=1)[::-1].argmin()) if (group != group[-1]).any() else 0
            if last:  # the last group may go on in the next batch
                yield of_groups(group[:last], prints[:last])
                group, prints = group[last:], prints[last:]
        if len(prints):
            yield of_groups(group, prints)

    return work


def links(prints: DataFrame, bits: int = 4, task_prints: int = TASK_PRINTS) -> DataFrame:
    """``u, v``: links between distinct fingerprints (column ``print``) that connect all that differ in at most ``bits`` bits."""
    if not 0 <= bits <= 5:
        raise ValueError("the two halves cover differences of at most 5 bits")

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column("print").slice(at, 4096).to_numpy().view(np.uint64)
                row, key = anchors(own)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row].view(np.int64))], ["anchor", "print"])

    rows = prints.select("print").mapInArrow(copied, "anchor long, print long")
    crowded = written(rows.groupBy("anchor").count().where(F.col("count") > task_prints)
                      .select("anchor", F.ceil(F.col("count") / task_prints).cast("long").alias("blocks")), "crowded")
    n = crowded.count()
    zero = F.lit(0).cast("long")
    if n == 0:
        rows = rows.select("anchor", zero.alias("a"), zero.alias("b"), "print")
    else:  # blocks of an anchor meet two by two, each pair of blocks in a task of its own
        rows = rows.join(F.broadcast(crowded) if n <= BROADCAST_ANCHORS else crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("print"), F.col("blocks"))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        rows = rows.select("anchor", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "print")
    rows = rows.repartition("anchor", "a", "b").sortWithinPartitions("anchor", "a", "b")
    return rows.mapInArrow(_links(bits), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node with a link; root is the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes. Each step writes its edges to the shared folder.
    """
    def ordered(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = written(ordered(edges), "links")
    now = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(ordered(small), "links")
        before, now = now, state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", task_prints: int = TASK_PRINTS) -> DataFrame:
    """``id, k1, k2, print, component`` for each row: its fingerprint, and the smallest id linked to it over any number of steps.

    Rows with equal fingerprints are one node. Null and empty texts have fingerprint zero and link like others. Null ids count only where a component has no other.
    Repeated rows come back as often. An empty table gives an empty result; further columns are ignored.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "prints")
    nodes = prints.groupBy("print").agg(F.min("id").alias("least"))
    joined = components(links(nodes, bits, task_prints))
    nodes = nodes.join(joined, nodes["print"] == joined["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    nodes = written(nodes, "print-roots")
    named = nodes.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(nodes.join(named, "root").select("print", "component", "root"), "print").select("id", "k1", "k2", "print", "component", "root")


def keep_one(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, that with the smallest id (then the smallest row key); null ids come last. All columns are passed on."""
    found = near_duplicates(docs, words, bits, id_col, text_col, **how)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), "k1", "k2")).alias("first"))
    a, b = free_names(docs, "__k1", "__k2")
    first = first.select(F.col("first.k1").alias(a), F.col("first.k2").alias(b))
    k1, k2 = row_keys(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumns({a: k1, b: k2}).join(first, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
