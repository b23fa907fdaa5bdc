"""Lines that many documents share, found in a sharded minimal perfect hash.

Over the distinct line hashes of a shard stands a minimal perfect hash; its
numbers index a compact array of fingerprints and arrays of document counts and
last holders. Documents send the hashes of their lines, never the lines, to the
shards and get back which lines go.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import free_names, slices, texts_of, written

#: Distinct hashes a shard holds on average.
SHARD_KEYS = 1 << 16
#: Probes that one task takes for a shard; a shard with more is copied to several tasks.
TASK_PROBES = 1 << 18
#: Shards up to which the table of copies (16 bytes a shard) is broadcast; beyond it Spark joins it as it sees fit.
BROADCAST_SHARDS = 1 << 20

_MIX = 0x9E3779B97F4A7C15


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64(_MIX * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct 64-bit keys, from a few bits a key.

    On a level keys that fall on a bit alone set it; the others go on to the next level. A key's number is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.rank = [np.cumsum(b) - b for b in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left):
            width = 2 * len(left) + 1
            at = (_mixed(left, len(levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for a key outside the set any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mixed(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = self.base[k] + self.rank[k][at[here]]
            left = left[~here]
        return out


class Shard:
    """Fingerprint, document count and last holder of each line hash of a shard."""

    FIELDS = ("fp", "n", "last", "held")

    def __init__(self, hash_: PerfectHash, arrays: dict[str, np.ndarray], twins: dict[str, np.ndarray]):
        self.hash, self.arrays, self.twins = hash_, arrays, twins

    @classmethod
    def of(cls, h1, h2, n, last, held) -> "Shard":
        """h1, h2: the halves of distinct line hashes; held: has the last holder an id?"""
        order = np.lexsort((h2, h1))
        h1, h2, n, last, held = (a[order] for a in (h1, h2, n, last, held))
        first = np.append(True, h1[1:] != h1[:-1]) if len(h1) else np.zeros(0, bool)
        hash_ = PerfectHash.of(h1[first])
        at = hash_.numbers(h1[first])
        arrays = {}
        for name, values in zip(cls.FIELDS, ((h2 >> np.uint64(32)).astype(np.uint32), n, last, held)):
            arrays[name] = np.zeros(len(at), values.dtype)
            arrays[name][at] = values[first]
        # different lines with the same first half: kept whole, beside
        twins = {"h1": h1[~first], "h2": h2[~first], "n": n[~first], "last": last[~first], "held": held[~first]}
        return cls(hash_, arrays, twins)

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, widths=np.array([len(b) for b in self.hash.levels], np.int64),
                 bits=np.packbits(np.concatenate([*self.hash.levels, np.zeros(0, bool)])),
                 **self.arrays, **{f"twin_{k}": v for k, v in self.twins.items()})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> "Shard":
        with np.load(io.BytesIO(data)) as z:
            widths = z["widths"]
            bits = np.unpackbits(z["bits"], count=int(widths.sum())).astype(bool)
            levels = np.split(bits, np.cumsum(widths)[:-1]) if len(widths) else []
            return cls(PerfectHash(levels), {k: z[k] for k in cls.FIELDS}, {k: z[f"twin_{k}"] for k in ("h1", "h2", "n", "last", "held")})

    def dropped(self, h1, h2, holder, has_id, min_docs: int) -> np.ndarray:
        """Is the line in at least min_docs documents, and this holder not the last?"""
        n, last, held = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64), np.zeros(len(h1), bool)
        at = self.hash.numbers(h1)
        ok = at >= 0
        ok[ok] = self.arrays["fp"][at[ok]] == (h2[ok] >> np.uint64(32)).astype(np.uint32)
        n[ok], last[ok], held[ok] = self.arrays["n"][at[ok]], self.arrays["last"][at[ok]], self.arrays["held"][at[ok]]
        for t in range(len(self.twins["h1"])):
            same = (h1 == self.twins["h1"][t]) & (h2 == self.twins["h2"][t])
            n[same], last[same], held[same] = self.twins["n"][t], self.twins["last"][t], self.twins["held"][t]
        return (n >= min_docs) & ~((has_id == held) & (~held | (holder == last)))


def _line_hashes(min_chars: int):
    """Distinct keys of each text, with the numbers of the lines that have them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, h1, h2, lines = [], [], [], []
            for r, text in enumerate(texts_of(batch)):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.split(b"\n")):
                    key = line.strip(b" \t\n\v\f\r").lower()  # of bytes: A-Z only
                    if len(key) >= min_chars:
                        found.setdefault(key, []).append(at)
                for key, at in found.items():
                    if len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    whole = xxhash.xxh128_intdigest(key)
                    row.append(r)
                    h1.append(whole >> 64)
                    h2.append(whole & 0xFFFFFFFFFFFFFFFF)
                    lines.append(at)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(row), batch.column("k1").take(row), batch.column("k2").take(row), pa.array(np.array(h1, np.uint64).view(np.int64)),
                 pa.array(np.array(h2, np.uint64).view(np.int64)), pa.array(lines, pa.list_(pa.int32()))], ["id", "k1", "k2", "h1", "h2", "lines"])

    return work


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """Two 64-bit keys of a row by its id and text; repeated rows share them."""
    return [F.xxhash64(id_col, text).alias("k1"), F.xxhash64(text, id_col, F.lit(1)).alias("k2")]


def _numpy(tab: pa.Table, name: str) -> np.ndarray:
    return tab.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)


def _valid(tab: pa.Table, name: str) -> np.ndarray:
    return tab.column(name).combine_chunks().is_valid().to_numpy(zero_copy_only=False)


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 shard_keys: int = SHARD_KEYS, task_probes: int = TASK_PROBES) -> DataFrame:
    """``k1, k2, dropped array<int>``: which lines (from 0) go from the rows with these row keys; rows that lose none are absent.

    A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least ``min_chars`` characters that stand in at least
    ``min_docs`` rows go everywhere but in the row with the largest id. Null ids come before all others; rows that share the largest id all keep the line.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = (docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", "text", *row_keys(F.col("id"), F.col("text")))
             .mapInArrow(_line_hashes(min_chars), "id long, k1 long, k2 long, h1 long, h2 long, lines array<int>"))
    counts = written(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")), "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))
    sharded = counts.withColumn("shard", F.pmod("h1", F.lit(shards)))

    def build(key, tab):
        shard = Shard.of(*(_numpy(tab, c).view(np.uint64) for c in ("h1", "h2")), _numpy(tab, "n"), _numpy(tab, "last"), _valid(tab, "last"))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([shard.dumped()], pa.binary())})

    # how many tasks take a shard: exact, as a shard's probes are the sum of its counts
    copies = sharded.groupBy("shard").agg(F.ceil(F.sum("n") / task_probes).cast("long").alias("copies"))
    copies = written(copies, "line-copies")
    arrays = (sharded.groupBy("shard").applyInArrow(build, "shard long, data binary").join(copies, "shard")
              .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("part"), "data"))
    copies = F.broadcast(copies) if shards <= BROADCAST_SHARDS else copies
    probes = (lines.withColumn("shard", F.pmod("h1", F.lit(shards))).join(copies, "shard")
              .withColumn("part", F.pmod(F.xxhash64("k1", "k2"), F.col("copies"))).select("shard", "part", "id", "k1", "k2", "h1", "h2", "lines"))

    def probe(key, rows, data):
        shard = Shard.loaded(data.column("data")[0].as_py())
        gone = shard.dropped(_numpy(rows, "h1").view(np.uint64), _numpy(rows, "h2").view(np.uint64), _numpy(rows, "id"), _valid(rows, "id"), min_docs)
        return rows.select(["k1", "k2", "lines"]).filter(pa.array(gone))

    keys = ["shard", "part"]
    gone = probes.groupBy(*keys).cogroup(arrays.groupBy(*keys)).applyInArrow(probe, "k1 long, k2 long, lines array<int>")
    # a list is as long as its document at most
    return gone.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("dropped"))


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
                      names: Sequence[str] = ("__n_lines", "__n_dropped", "__kept"), **how) -> DataFrame:
    """``docs`` with three further columns ``names``: the number of lines, of dropped ones, and the text without the lines of ``shared_lines``.

    A null or empty text is one empty line and stays empty. Repeated rows count as documents of their own and come back as often; an empty table gives an
    empty result. All columns of ``docs`` are passed on whatever their names; ``names`` must be none of them.
    """
    a, b, which, lines = free_names(docs, "__k1", "__k2", "__dropped", "__lines")
    gone = shared_lines(docs, min_chars, min_docs, id_col, text_col, **how).select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("dropped").alias(which))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = row_keys(F.col(id_col).cast("long"), text)
    out = docs.withColumns({a: k1, b: k2}).join(gone, [a, b], "left")
    out = out.withColumn(lines, F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(which))
    return out.withColumns({
        names[0]: F.size(lines).cast("long"), names[1]: F.coalesce(F.size(which), F.lit(0)).cast("long"),
        names[2]: F.when(F.col(which).isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")),
    }).drop(a, b, which, lines)
