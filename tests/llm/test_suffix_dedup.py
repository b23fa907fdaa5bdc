import random

import numpy as np

from llm.conftest import EDGES, frame, same
from loomwork.llm import suffix_dedup as sd


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, t in data:
        for k in range(len(t) - length + 1):
            seen[t[k:k + length]] = seen.get(t[k:k + length], 0) + 1
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def got(spark, rows, **how):
    return [(*r[:4], bytes(r[4])) for r in sd.remove_repeats(frame(spark, rows), **how).collect()]


def texts(seed=3):
    rng = random.Random(seed)
    parts = ["ab", "ba", "aab", "c ", "é"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    base = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(4)]
    out += [x[:rng.randint(0, 50)] + rng.choice(base)[rng.randint(0, 30):] + x[-20:] for x in out]
    return list(enumerate(out + out[:5] + ["abab" * 40, "x" * 90, ""]))


def test_against_brute_force(spark):
    rows = texts()
    want = brute(rows, 24)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)
    assert same(got(spark, rows, length=24, k=6), want)
    # every anchor with several surroundings is crowded
    assert same(got(spark, rows, length=24, k=6, task_contexts=1), want)


def test_edge_rows(spark):
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(260))
    rows = EDGES + [(40, passage[:199]), (41, "q" + passage[:200] + "r"), (42, passage[:200]), (43, passage[30:240]), (44, "é" * 99), (45, "é" * 150)]
    assert same(got(spark, rows), brute(rows, 200))
    assert got(spark, []) == []


def contexts(seed=1, n=300):
    rng = random.Random(seed)
    texts_, left, group = [], [], []
    for i in range(n):
        l, r = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 16)))
        texts_.append((l + "KKKK" + r).encode())
        left.append(len(l))
        group.append(i % 7)
    order = np.argsort(group, kind="stable")
    return sd.Contexts(np.array(group)[order], [texts_[i] for i in order], np.array(left)[order], 20)


def test_the_hash_sort_is_the_byte_sort():
    c = contexts()
    for back in (False, True):
        items, agree = c.neighbours(back)
        by_bytes, agree_bytes = c._by_bytes(back)
        assert (agree == agree_bytes).all()
        key = lambda i: c.buffer[c.place[i] - c.left[i]:c.place[i]][::-1] if back else c.buffer[c.place[i]:c.place[i] + c.right[i]]
        assert [key(i) for i in items] == [key(i) for i in by_bytes]


def test_a_collision_is_noticed(monkeypatch):
    c = contexts()
    want = c.repeated(4)
    # every hash equal: all extensions look whole, the bytes tell otherwise
    monkeypatch.setattr(sd.Hashes, "of", lambda self, row, at, length: np.zeros(len(at), np.uint64))
    assert (contexts().repeated(4) == want).all()


def test_each_window_has_one_anchor_and_equal_ones_at_the_same_place():
    rng = random.Random(9)
    docs = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 90))) for _ in range(60)] + [b"ab" * 60, b"x" * 90, b"abc" * 30 + b"abd" * 30]
    doc, at, first, last, h = sd.anchors(docs, 20, 6)
    place = {}
    for d, p, a, b in zip(doc.tolist(), at.tolist(), first.tolist(), last.tolist()):
        for s in range(a, b + 1):
            assert (d, s) not in place and s <= p <= s + 14
            place[d, s] = p
    assert set(place) == {(d, s) for d, t in enumerate(docs) for s in range(len(t) - 19)}
    seen = {}
    for (d, s), p in place.items():
        assert seen.setdefault(docs[d][s:s + 20], p - s) == p - s
    assert len(h) < 0.3 * len(place)
