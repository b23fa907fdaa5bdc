"""Long repeated byte strings, by a suffix sort whose comparisons are hash look-ups.

Only suffixes at anchors are sorted. The anchor of a window of ``length`` bytes is the
leftmost place of its least k-byte hash; equal windows have their anchor at the same
place, so a repeated window shows as two anchors with the same k bytes. The bytes of all
windows of an anchor are its context. Anchors whose contexts are all alike are settled by
counting. Where they differ, each different context goes once to a task that sorts the
suffixes to the right of the anchors, and the prefixes to their left, by mergesort: prefix
polynomial hashes give the hash of any substring, binary search over lengths finds a
common extension, so a comparison takes logarithmically many steps. The extensions of
neighbours, verified on the bytes, then tell which windows occur twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import slices, texts_of, written

#: Bytes of an anchor.
ANCHOR = 40
#: Contexts of one anchor string that one task sorts; beyond it windows are counted by their hash.
TASK_CONTEXTS = 1 << 17
#: Contexts sorted at a time, unless one anchor has more (some 3 kB of hashes each).
CHUNK = 1 << 14

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


_power_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power_cache.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 21), np.uint64)
        have[1:] = np.uint64(base)
        _power_cache[base] = have = np.cumprod(have)
    return have[:n]


class Hashes:
    """Hashes of all substrings of the texts in a buffer: prefix sums of byte * base^place, brought to place 0 by the inverse power.

    Places count from the start of a row of ``width`` bytes; a text lies within a row.
    """

    def __init__(self, data: np.ndarray, width: int):
        rows = -(-len(data) // width)
        self.width = width
        self.prefix = np.zeros((rows, width + 1), np.uint64)
        padded = np.zeros(rows * width, np.uint8)
        padded[:len(data)] = data
        np.cumsum(_BYTE[padded.reshape(rows, width)] * _powers(_BASE, width), axis=1, out=self.prefix[:, 1:])
        self.prefix = self.prefix.reshape(-1)
        self.back = _powers(_UNBASE, width + 1)

    def of(self, row: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of the bytes ``at`` to ``at + length`` of rows."""
        begin = row * (self.width + 1) + at
        return (self.prefix[begin + length] - self.prefix[begin]) * self.back[at]


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of each ``width`` neighbours, by doubling."""
    reach = 1
    out = x
    while 2 * reach <= width:
        out = best(out[:-reach], out[reach:])
        reach *= 2
    return best(out[:len(x) - width + 1], out[width - reach: len(x) - reach + 1]) if reach < width else out


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which text, place, first window, last window, k-byte hash) of the anchors of all windows of ``length`` bytes within the texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    prefix = Hashes(data, len(data))
    n = len(data) - k + 1
    h = (prefix.prefix[k:] - prefix.prefix[:n]) * prefix.back[:n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = length - k + 1
    least = _slide(h, width, np.minimum)
    whole = np.ones(len(least), bool)  # windows that lie in one text
    for stop in stops[:-1].tolist():
        whole[max(0, stop - length + 1): stop] = False
    least = np.where(whole, least, 0)
    # a place is an anchor if the greatest least hash of the windows around it is its own
    edge = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    places = np.flatnonzero((most == h) & (most > 0))
    # windows in a row with the same least hash share the leftmost place that has it, up to that place
    cut = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    first, last = cut, np.append(cut[1:], len(least)) - 1
    first, last = first[least[first] > 0], last[least[first] > 0]
    found = []
    while len(first):
        at = np.searchsorted(places, first)
        while len(other := np.flatnonzero(h[places[at]] != least[first])):
            at[other] += 1
        at = places[at]
        found.append(np.stack([at, first, np.minimum(last, at)]))
        more = at < last  # the hash comes again in later windows
        first, last = at[more] + 1, last[more]
    at, first, last = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    doc = np.searchsorted(stops, at, "right")
    begin = (stops - sizes)[doc]
    return doc, at - begin, first - begin, last - begin, h[at]


def _anchor_rows(length: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            doc, at, first, last, h = anchors(texts, length, k)
            around = np.fromiter((digest(texts[d][a:b], c) for d, a, b, c in zip(doc.tolist(), first.tolist(), (last + length).tolist(), (at - first).tolist())), np.uint64, len(at))
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), batch.column("k1").take(rows), batch.column("k2").take(rows),
                                              pa.array((first << 16) | ((at - first) << 8) | (last - first))], ["anchor", "around", "k1", "k2", "place"])

    return work


class Contexts:
    """A buffer of contexts, each with its group (the anchor) and the place of its anchor, and the orders of their suffixes and prefixes."""

    def __init__(self, group: np.ndarray, texts: list[bytes], left: np.ndarray, length: int):
        sizes = np.array([len(t) for t in texts])
        self.length, self.group = length, group
        self.width = int(sizes.max())
        self.buffer = b"".join(t.ljust(self.width, b"\0") for t in texts)
        self.data = np.frombuffer(self.buffer, np.uint8)
        self.hashes = Hashes(self.data, self.width)
        self.place = np.arange(len(texts)) * self.width + left
        self.left, self.right = left, np.minimum(sizes - left, length)

    def extension(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How far items a and b agree, to the right of their anchors or (back) to the left: binary search over lengths."""
        room = self.left if back else self.right
        low, high = np.zeros(len(a), np.int64), np.minimum(room[a], room[b])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            x, y = (self.left[a] - mid, self.left[b] - mid) if back else (self.left[a], self.left[b])
            same = self.hashes.of(a, x, mid) == self.hashes.of(b, y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, back: bool, equal: np.ndarray) -> np.ndarray:
        """Is a before b? Where they are equal: ``equal``."""
        room = self.left if back else self.right
        e = self.extension(a, b, back)
        ends_a, ends_b = e == room[a], e == room[b]
        x, y = (self.place[a] - 1 - e, self.place[b] - 1 - e) if back else (self.place[a] + e, self.place[b] + e)
        top = len(self.data) - 1
        by_byte = self.data[np.clip(x, 0, top)] < self.data[np.clip(y, 0, top)]
        return np.where(ends_a & ends_b, equal, np.where(ends_a, True, np.where(ends_b, False, by_byte)))

    def order(self, back: bool) -> np.ndarray:
        """Items by group, then by their bytes: bottom-up mergesort of all groups at once, ranks by binary search in the sister run."""
        items = np.argsort(self.group, kind="stable")
        g = self.group[items]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(first, len(g)))
        start, count = np.repeat(first, size), np.repeat(size, size)
        q = np.arange(len(items)) - start
        width = 1
        while (count > width).any():
            mine = q // width
            sister = start + (mine ^ 1) * width
            stop = np.minimum(sister + width, start + count)
            p = np.flatnonzero(sister < stop)  # those that have something to merge with
            low, high, is_left = sister[p].copy(), stop[p].copy(), mine[p] % 2 == 0
            while True:
                open_ = np.flatnonzero(low < high)
                if len(open_) == 0:
                    break
                mid = (low[open_] + high[open_]) >> 1
                # an item of the left run goes before equal ones of the right run
                before = self.less(items[mid], items[p[open_]], back, ~is_left[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = np.arange(len(items))
            to[p] = start[p] + (mine[p] // 2) * 2 * width + q[p] % width + (low - sister[p])
            merged = np.empty_like(items)
            merged[to] = items
            items = merged
            width *= 2
        return items

    def neighbours(self, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """The order, and how far each item agrees with the one before it (-1 for the first of a group); verified on the bytes."""
        items = self.order(back)
        agree = np.full(len(items), -1)
        same = np.flatnonzero(self.group[items[1:]] == self.group[items[:-1]])
        agree[same + 1] = self.extension(items[same], items[same + 1], back)
        for p, e in zip((same + 1).tolist(), agree[same + 1].tolist()):
            x, y = int(self.place[items[p - 1]]), int(self.place[items[p]])
            if self._differ(x, y, e, back):
                return self._by_bytes(back)
        return items, agree

    def _differ(self, x: int, y: int, e: int, back: bool) -> bool:
        if back:
            return self.buffer[x - e:x] != self.buffer[y - e:y]
        return self.buffer[x:x + e] != self.buffer[y:y + e]

    def _by_bytes(self, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same after a collision of hashes, with the bytes themselves."""
        keys = [self.buffer[p - b:p][::-1] if back else self.buffer[p:p + r] for p, b, r in zip(self.place.tolist(), self.left.tolist(), self.right.tolist())]
        items = sorted(range(len(keys)), key=lambda i: (self.group[i], keys[i]))
        agree = [-1] * len(items)
        for p in range(1, len(items)):
            x, y = keys[items[p - 1]], keys[items[p]]
            if self.group[items[p - 1]] == self.group[items[p]]:
                agree[p] = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        return np.array(items), np.array(agree)

    def repeated(self, k: int) -> np.ndarray:
        """Matrix (item, bytes to the left of the anchor): does this window of ``length`` bytes occur in another item of the group?"""
        right_items, right_agree = self.neighbours(False)
        left_items, left_agree = self.neighbours(True)
        n = len(self.group)
        out = np.zeros((n, self.length - k + 1), bool)
        right_class, left_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in range(self.length - k + 1):
            fits = np.flatnonzero((self.left >= b) & (self.right >= self.length - b))
            # items in one class agree over the part of the window on that side
            right_class[right_items] = np.cumsum(right_agree < self.length - b)
            left_class[left_items] = np.cumsum(left_agree < b)
            key = right_class[fits] * (n + 1) + left_class[fits]
            order = np.argsort(key)
            twin = key[order][1:] == key[order][:-1]
            out[fits[order[1:][twin]], b] = out[fits[order[:-1][twin]], b] = True
        return out


SPANS = "anchor long, around long, start int, stop int"


def _settle(length: int, k: int):
    """Rows sorted by anchor in; for each context the bytes (from its anchor) that repeated windows cover out."""

    def spans(anchor, around, texts, left) -> pa.RecordBatch:
        group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))
        found = Contexts(group, texts, left, length).repeated(k)
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        item, low = np.nonzero(edges == 1)
        high = np.nonzero(edges == -1)[1] - 1
        return pa.RecordBatch.from_arrays([pa.array(anchor[item]), pa.array(around[item]), pa.array(-high, pa.int32()), pa.array(length - low, pa.int32())],
                                          ["anchor", "around", "start", "stop"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, around, left, texts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            anchor, around, left = (np.append(a, batch.column(c).to_numpy().astype(np.int64)) for a, c in ((anchor, "anchor"), (around, "around"), (left, "left")))
            texts += batch.column("context").to_pylist()
            if len(texts) < CHUNK:
                continue
            whole = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
            if whole:
                yield spans(anchor[:whole], around[:whole], texts[:whole], left[:whole])
                anchor, around, left, texts = anchor[whole:], around[whole:], left[whole:], texts[whole:]
        if texts:
            yield spans(anchor, around, texts, left)

    return work


def _windows(length: int):
    """Each window around an anchor with two hashes, for anchors with too many contexts for one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, back, w1, w2 = [], [], [], []
            for r, (text, left) in enumerate(zip(batch.column("context").to_pylist(), batch.column("left").to_pylist())):
                for at in range(len(text) - length + 1):
                    whole = xxhash.xxh3_128_intdigest(text[at: at + length])
                    row.append(r)
                    back.append(left - at)
                    w1.append(whole >> 64)
                    w2.append(whole & 0xFFFFFFFFFFFFFFFF)
            rows = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(rows), batch.column("around").take(rows), pa.array(back, pa.int32()),
                                              pa.array(np.array(w1, np.uint64).view(np.int64)), pa.array(np.array(w2, np.uint64).view(np.int64))], ["anchor", "around", "back", "w1", "w2"])

    return work


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they go through shuffles."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches, "text"):
        packed = pa.array([pack.compress(t) for t in texts_of(batch)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k1"), batch.column("k2"), packed], ["id", "k1", "k2", "packed"])


def _cut(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, places in zip(batch.column("packed").to_pylist(), batch.column("places").to_pylist()):
                text = unpack.decompress(packed)
                for p in places:
                    first, left, more = p["place"] >> 16, (p["place"] >> 8) & 255, p["place"] & 255
                    out.append((p["anchor"], p["around"], left, text[first: first + more + length]))
            for at in range(0, len(out), 8192):
                cols = list(zip(*out[at: at + 8192]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())],
                                                 ["anchor", "around", "left", "context"])

    return work


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes, removed, runs, kept = [], [], [], []
        for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
            text = unpack.decompress(packed)
            parts, gone, n, at = [], 0, 0, 0
            for s in sorted((max(0, x["start"]), min(len(text), x["stop"])) for x in spans or ()):
                if s[0] > at or n == 0:  # spans that touch are one run
                    parts.append(text[at:s[0]])
                    n += 1
                    at = s[0]
                if s[1] > at:
                    gone += s[1] - at
                    at = s[1]
            parts.append(text[at:])
            sizes.append(len(text))
            removed.append(gone)
            runs.append(n)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                         ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", k: int = ANCHOR, task_contexts: int = TASK_CONTEXTS) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept binary`` for each row: its UTF-8 text without the bytes of repeated strings of ``length`` bytes.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or another; strings do not cross texts, may overlap, and are
    judged on the input. ``n_spans`` counts maximal removed runs. Null texts are empty; repeated rows are texts of their own (and so lose what they share); ids are
    passed on. An empty table gives an empty result; further columns are ignored.
    """
    if not 0 < k <= length <= k + 255:
        raise ValueError("an anchor is shorter than a string, by at most 255 bytes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.xxhash64("id", "text").alias("k1"), F.pmod(F.xxhash64("text", "id", F.lit(1)), F.lit(2147483647)).cast("int").alias("k2"))
    keys = ["k1", "k2"]
    found = rows.mapInArrow(_anchor_rows(length, k), "anchor long, around long, k1 long, k2 int, place long")
    # anchors that occur twice; are all their surroundings alike?
    twice = written(found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("around").alias("least"), F.max("around").alias("most"))
                    .where("n > 1").select("anchor", F.expr("least <> most").alias("mixed")), "anchors")
    found = written(found.join(twice, "anchor"), "repeated-anchors")
    # a place holds the first window, the bytes from there to the anchor, and the windows after the first
    first, left, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    alike = found.where(~F.col("mixed")).select(*keys, first.alias("start"), (first + more + length).alias("stop"))
    mixed = found.where("mixed").drop("mixed")
    # one context for each different surrounding goes on, however often it occurs
    contexts = mixed.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("first"))
    contexts = written(contexts.select("anchor", "around", "n", "first.*"), "contexts")
    packed = rows.mapInArrow(_pack, "id long, k1 long, k2 int, packed binary")
    places = contexts.groupBy(*keys).agg(F.collect_list(F.struct("anchor", "around", "place")).alias("places"))  # no more than the text has anchors
    cut = packed.join(places, keys).select("packed", "places").mapInArrow(_cut(length), "anchor long, around long, left int, context binary")
    crowded = written(contexts.groupBy("anchor").count().where(F.col("count") > task_contexts).select("anchor"), "crowded")
    if crowded.limit(1).count():
        cut = written(cut, "cut")
        few, many = cut.join(crowded, "anchor", "left_anti"), cut.join(crowded, "anchor", "left_semi")
        windows = many.mapInArrow(_windows(length), "anchor long, around long, back int, w1 long, w2 long").distinct()
        again = written(windows.groupBy("anchor", "back", "w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "windows")
        crowd = windows.join(again, ["anchor", "back", "w1", "w2"]).select("anchor", "around", (-F.col("back")).alias("start"), (length - F.col("back")).alias("stop"))
    else:
        few, crowd = cut, None
    settled = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_settle(length, k), SPANS)
    settled = settled if crowd is None else settled.union(crowd)
    often = contexts.where("n > 1").select("anchor", "around", (-left).alias("start"), (more - left + length).alias("stop"))
    at = first + left
    some = mixed.join(settled.union(often), ["anchor", "around"]).select(*keys, (at + F.col("start")).alias("start"), (at + F.col("stop")).alias("stop"))
    spans = alike.union(some).groupBy(*keys).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # no more than the text has anchors
    return packed.join(spans, keys, "left").select("id", "packed", "spans").mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
