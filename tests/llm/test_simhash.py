import random
import re

import numpy as np
import xxhash

from llm.conftest import EDGES, frame, same
from loomwork.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(prints, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(a) for a in range(len(prints))]


def brute(rows, bits=4):
    prints = [fingerprint(t) for _, t in rows]
    of = groups(prints, bits)
    least = {}
    for (i, _), g in zip(rows, of):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, np.uint64(p).astype(np.int64).item(), least.get(g)) for (i, _), p, g in zip(rows, prints, of)]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        out.append(" ".join(t))
    return list(enumerate(out))


def test_against_brute_force(spark):
    rows = texts() + EDGES
    want = brute(rows)
    assert len({w[2] for w in want}) < len(rows) - 5
    for how in ({}, {"task_prints": 4}):  # the second: every anchor with company is crowded
        got = simhash.near_duplicates(frame(spark, rows), **how).select("id", "print", "component").collect()
        assert same(got, want)


def test_keep_one(spark):
    rows = texts(30) + EDGES + [(None, "only one without an id"), (None, "only one without an id")]
    df = frame(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    of = groups([fingerprint(t) for _, t in rows], 4)
    first = {}
    for (i, t), g in zip(rows, of):
        first[g] = min(first.get(g, (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(first.values())


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_any_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 6, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ra, ka), (rb, kb) = simhash.anchors(a), simhash.anchors(b)
    for i in range(len(a)):
        assert set(ka[ra == i].tolist()) & set(kb[rb == i].tolist())
    assert 25 < len(ka) / len(a) < 33


def test_every_word_is_covered_once():
    near, far = simhash._patterns()
    assert (near > 0).sum() == 2047 and (far >= 0).sum() == 8855
    words = np.arange(1 << 23)
    assert (simhash._syndromes(words[::997] ^ near[simhash._syndromes(words[::997])]) == 0).all()


def test_spanning_links_join_what_is_close():
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    u, v = simhash.spanning_links(prints, 2)
    assert len(u) <= len(prints) - 1
    at = {p: i for i, p in enumerate(prints.tolist())}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        x, y = sorted((find(at[a]), find(at[b])))
        parent[y] = x
    assert [find(i) for i in range(len(prints))] == groups(prints.tolist(), 2)


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(500, 501), (502, 501), (9, 3)]
    got = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.node, r.root) for r in got} == {(k, 0) for k in range(201)} | {(k, 500) for k in (500, 501, 502)}
    assert len(got) == 204
