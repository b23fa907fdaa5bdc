"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

The symbols of many words lie in flat arrays. In a round every word finds its
best pair (a segmented minimum of pair ranks) and merges all its leftmost
occurrences at once; then the arrays are compacted. Words without a pair leave.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import slices

SPACE_MARK = "▁"
#: Bytes of text that are encoded at once, and looked through for a place to cut.
CODEC_BYTES = 1 << 20
WINDOW = 1 << 16
NONE = np.int64(1 << 40)
GONE = np.int64(-(1 << 40))


def _each_byte(error):
    """One replacement character for each byte that is not UTF-8."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


def _spread(begin: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``begin[i]``, ``begin[i] + 1``, ... of runs of ``n[i]``, where ``after`` are the running sums of ``n``; all int32."""
    at = np.repeat(begin - (after - n), n)
    at += np.arange(len(at), dtype=np.int32)
    return at


class Lookup:
    """A fixed map from non-negative int64 keys to places in an array, for whole arrays of keys at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.keys = np.append(keys.astype(np.int64), -1)
        left, slot = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several for one slot the last stays
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self._first(keys)
        at = self.slots[slot]
        open_ = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at[open_] = got = self.slots[slot[open_]]
            open_ = open_[(got >= 0) & (self.keys[got] != keys[open_])]
        return at


class PieceModel:
    """The tables of a SentencePiece BPE model file, and the two directions.

    Handles models with identity normalisation, a dummy prefix, escaped spaces and byte fallback; others are refused.
    """

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if (proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix
                or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix
                or any(p.type in (4, 5) for p in proto.pieces)):
            raise ValueError("only BPE with identity normalisation, dummy prefix and byte fallback")
        self.end_id = sentencepiece.SentencePieceProcessor(model_proto=data).eos_id()
        size = len(proto.pieces)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        # characters that occur in pieces without being one get numbers behind the pieces
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, size + len(symbols))
        chars = sorted((ord(c), i) for c, i in symbols.items() if len(c) == 1)
        self.chars = Lookup(np.array([c for c, _ in chars], np.int64))
        self.char_symbol = np.array([i for _, i in chars] + [-1], np.int64)
        pairs, merged, rank, inside = [], [], [], set()
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                inside.add((ord(piece[k - 1]) << 32) | ord(piece[k]))
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    pairs.append((left << 32) | right)
                    merged.append(i)
                    rank.append(order[proto.pieces[i].score])
        self.pairs = Lookup(np.array(pairs, np.int64))
        self.merged, self.rank = np.array([*merged, -1], np.int64), np.array([*rank, NONE], np.int64)
        # a piece is risky if it is part of a piece that comes before it: its merge can make a pair that is due at once
        own, part = np.full(size + len(symbols) + 1, NONE), np.full(size + len(symbols) + 1, NONE)
        own[merged] = rank
        np.minimum.at(part, [p >> 32 for p in pairs] + [p & 0xFFFFFFFF for p in pairs], rank + rank)
        self.risky = part <= own
        self.inside = Lookup(np.array(sorted(inside), np.int64))
        self.size = size
        self.bytes_id = np.zeros(256, np.int64)
        surface = []
        self.starts_with_space = np.zeros(size, bool)
        self.visible = np.ones(size, bool)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes_id[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 3:
                surface.append(b"")
                self.visible[i] = False
            elif p.type == 2:
                surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                surface.append(p.piece.replace(SPACE_MARK, " ").encode())
                self.starts_with_space[i] = p.piece.startswith(SPACE_MARK)
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int32)
        self.surface_at = np.cumsum(self.surface_len, dtype=np.int32) - self.surface_len

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of the pair, -1 (no merge) where a symbol is in no piece."""
        at = self.pairs.find((np.maximum(left, 0) << 32) | np.maximum(right, 0))
        at[(left < 0) | (right < 0)] = -1
        return at

    def merge_words(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols at the places where they start, GONE at places merged into one before.

        codes: characters of all words; first: is a character the first of its word?
        Symbols below 0 stand for characters outside all pieces.
        """
        n = len(codes)
        out = np.full(n, GONE)
        if n == 0:
            return out
        sym = self.char_symbol[self.chars.find(codes)]
        sym = np.where(sym < 0, -codes - 1, sym)
        # a word falls apart where two characters are neighbours in no piece: no merge can cross
        cut = first.copy()
        cut[1:] |= self.inside.find((codes[:-1] << 32) | codes[1:]) < 0
        seg, pos = np.cumsum(cut), np.arange(n)
        pair = np.full(n, -1)
        near = np.flatnonzero(seg[1:] == seg[:-1])
        pair[near] = self._pair(sym[near], sym[near + 1])
        while True:
            rank = self.rank[pair]
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(seg))))
            live = best < NONE
            if not live.all():
                out[pos[~live]] = sym[~live]
                sym, seg, pos, pair, rank, best = (a[live] for a in (sym, seg, pos, pair, rank, best))
            if len(sym) == 0:
                return out
            take = self._leftmost(rank == best)
            take = self._in_order(sym, seg, pair, best, take)
            at = np.flatnonzero(take)
            sym[at] = self.merged[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            changed = take[keep]
            sym, seg, pos, pair = (a[keep] for a in (sym, seg, pos, pair))
            changed[:-1] |= changed[1:]  # the pair before a merged symbol is new too
            again = np.flatnonzero(changed)
            pair[again] = -1
            again = again[again + 1 < len(sym)]
            again = again[seg[again] == seg[again + 1]]
            pair[again] = self._pair(sym[again], sym[again + 1])

    @staticmethod
    def _leftmost(wanted: np.ndarray) -> np.ndarray:
        """Of neighbouring pairs, which share a symbol, the first, third, ... of each run."""
        at = np.arange(len(wanted))
        run = wanted & ~np.append(False, wanted[:-1])
        return wanted & ((at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0)

    def _in_order(self, sym, seg, pair, best, take):
        """Keep only the first merge where a merge makes a pair that comes before the word's other merges."""
        at = np.flatnonzero(take)
        at = at[self.risky[self.merged[pair[at]]]]
        if len(at) == 0:
            return take
        made = self.merged[pair[at]]
        soon = np.full(len(at), NONE)
        has = at + 2 < len(sym)
        has[has] = seg[at[has] + 2] == seg[at[has]]
        soon[has] = self.rank[self._pair(made[has], sym[at[has] + 2])]
        before = np.where((at >= 2) & take[at - 2], self.merged[pair[at - 2]], sym[at - 1])
        has = at >= 1
        has[has] = seg[at[has] - 1] == seg[at[has]]
        soon[has] = np.minimum(soon[has], self.rank[self._pair(before[has], made[has])])
        early = seg[at[soon <= best[at]]]
        if len(early):
            late = np.zeros(seg[-1] + 1, bool)
            late[early] = True
            at = np.flatnonzero(take)
            firsts = np.append(True, seg[at][1:] != seg[at][:-1])
            take = take.copy()
            take[at[~firsts & late[seg[at]]]] = False
        return take

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        if len(words) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = pa.concat_arrays([words])  # a buffer of its own
        lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
        chars = words.buffers()[2].to_pybytes()[offsets[0]: offsets[-1]].decode()
        codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        out = self.merge_words(codes, np.append(True, word[1:] != word[:-1]))
        kept = out != GONE
        sym, word = out[kept], word[kept]
        other = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(other):  # byte fallback, for the symbols that are no piece
            distinct, which = np.unique(codes[np.flatnonzero(kept)[other]], return_inverse=True)
            raw = [chr(c).encode() for c in distinct.tolist()]
            size = np.array([len(r) for r in raw])
            begin = np.cumsum(size) - size
            count = np.ones(len(sym), np.int64)
            count[other] = size[which]
            at = np.cumsum(count) - count
            ids = np.repeat(sym, count)
            n = size[which]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            fallback = self.bytes_id[np.frombuffer(b"".join(raw), np.uint8)]
            ids[np.repeat(at[other], n) + inner] = fallback[np.repeat(begin[which], n) + inner]
            sym, word = ids, np.repeat(word, count)
        return sym, np.bincount(word, minlength=len(words))

    def _cut(self, data: bytes, at: int, most: int) -> int:
        """A place behind ``at``, about ``most`` bytes on, where no piece can lie across; else the first one after that, or the end."""
        wide = max(min(WINDOW, most // 2), 8)
        low = at + max(most - wide, 1)
        while low < len(data):
            high = min(low + wide, len(data))
            # whole characters, and the one before them
            a, b = low, high
            while a > at and data[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            window = data[a:b].decode()
            codes = np.frombuffer(window.replace(" ", SPACE_MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
            cuts = np.flatnonzero(self.inside.find((codes[:-1] << 32) | codes[1:]) < 0)
            if len(cuts):
                return a + len(window[: cuts[-1] + 1].encode())
            if b == len(data):
                break
            low = max(b - 4, low + 1)  # the last character again: it may part from the next
        return len(data)

    def encode_long(self, data: bytes, most: int) -> Iterator[np.ndarray]:
        """The ids of one text in UTF-8, without an end id, for about ``most`` bytes at a time."""
        at = 0
        while at < len(data):
            to = self._cut(data, at, most) if len(data) - at > most else len(data)
            yield self.encode(pa.array([data[at:to].decode()]), end=False, prefix=at == 0).flatten().to_numpy()
            at = to

    def encode(self, texts: pa.StringArray, end: bool = True, prefix: bool = True) -> pa.ListArray:
        """Ids of each text. A null text is empty; an empty text has the end id alone. ``prefix`` is off for a text that goes on from another."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), " ", SPACE_MARK)
        if prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(SPACE_MARK, texts, ""))
        texts = pa.concat_arrays([texts])  # offsets from 0
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
        base = ends[0]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[base: ends[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
        ends = ends - base
        mark = np.zeros(len(data) + 3, bool)
        if len(data) >= 3:
            mark[3:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begins = mark[3:] & ~mark[:-3]
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.flatnonzero(begins)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data.tobytes()))
        coded = words.dictionary_encode()
        ids, count = self.encode_words(coded.dictionary)
        offset = (np.cumsum(count) - count).astype(np.int32)
        which = coded.indices.to_numpy()
        n = count[which].astype(np.int32)
        after = np.cumsum(n, dtype=np.int32)
        flat = ids.astype(np.int32)[_spread(offset[which], after, n)]
        doc_end = np.append(0, after)[np.searchsorted(starts, ends[1:])]
        if end:
            flat = np.insert(flat, doc_end, self.end_id)
            doc_end = doc_end + np.arange(1, len(texts) + 1)
        return pa.ListArray.from_arrays(pa.array(np.append(0, doc_end).astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))

    def surfaces(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids, one after the other."""
        n = self.surface_len[ids]
        return self.surface[_spread(self.surface_at[ids], np.cumsum(n, dtype=np.int32), n)].tobytes()

    def decode_long(self, parts: Iterable[np.ndarray]) -> bytes:
        """The text, in UTF-8, of one list of ids that comes in parts and holds no invisible id."""
        first, out = True, []
        for ids in parts:
            data = self.surfaces(ids)
            out.append(data[1:] if first and len(ids) and self.starts_with_space[ids[0]] else data)
            first = first and len(ids) == 0
        data = b"".join(out)
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "each_byte").encode()

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """The text of each list of ids; bytes that are not UTF-8 become replacement characters."""
        flat = ids.flatten().to_numpy()
        lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc_end = np.cumsum(lens)
        doc = np.repeat(np.arange(len(ids)), lens)
        after = np.cumsum(self.surface_len[flat], dtype=np.int32)
        seen = np.flatnonzero(self.visible[flat])
        first = seen[np.append(True, doc[seen][1:] != doc[seen][:-1])] if len(seen) else seen
        skip = np.zeros(len(ids), np.int64)
        skip[doc[first]] = self.starts_with_space[flat[first]]
        stop = np.append(0, after)[doc_end]
        start = np.append(0, stop[:-1]) + skip
        raw = self.surfaces(flat)
        out = [raw[a:b].decode("utf-8", "each_byte") for a, b in zip(start.tolist(), stop.tolist())]
        # an invisible id inside a list keeps the bytes before and after it apart
        hidden = np.flatnonzero(~self.visible[flat])
        inner = hidden[hidden + 1 < doc_end[doc[hidden]]]
        for d in np.unique(doc[inner]).tolist():
            cuts = [start[d], *np.maximum(after[inner[doc[inner] == d]], start[d]).tolist(), stop[d]]
            out[d] = "".join(raw[a:b].decode("utf-8", "each_byte") for a, b in zip(cuts, cuts[1:]))
        return pa.array(out, pa.string())


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded string`` for each row of ``docs``.

    The ids are those of the sentencepiece library without sampling, with an end id; ``decoded`` is what they decode to.
    A null text counts as empty; ids, also null and repeated ones, are passed on; further columns are ignored. The model's bytes travel with the job.
    Python works on ``CODEC_BYTES`` of text at a time. A longer text is cut where no piece can lie across, so that of it only the text, the ids and what they
    decode to are held at once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(model)
        for batch in slices(batches, "text", CODEC_BYTES):
            if batch.num_rows == 1 and batch.column("text")[0].is_valid and batch.column("text")[0].as_buffer().size > CODEC_BYTES:
                parts = list(pieces.encode_long(batch.column("text")[0].as_buffer().to_pybytes(), CODEC_BYTES))
                decoded = pa.array([pieces.decode_long(parts)], pa.binary()).cast(pa.string())
                flat = np.concatenate([*parts, np.array([pieces.end_id], np.int32)])
                ids = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
            else:
                ids = pieces.encode(batch.column("text"))
                decoded = pieces.decode(ids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, decoded], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(work, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col))
