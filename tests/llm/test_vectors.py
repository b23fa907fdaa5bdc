"""Operators 11 to 13 against plain brute force in Python's own integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import same
from loomwork.llm import centroids, grid_order, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, d2 string, cluster int, node int, n_links int, slot string, `at` int, code string, error int"
INF, NAN = float("inf"), float("nan")
MORE = ("own", 1, "own", 2, 3, 4, "own", 5, "own", 6)


def frame(spark, rows, schema=SCHEMA):
    """rows: (vec_id, vector, label); further columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, *MORE) for r in rows], schema).repartition(3)


def rows_of(rng, n, dim, spread=0.3, labels=4):
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dim)], rng.choice([*range(labels), None])) for i in range(n)]


def kept(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]


def whole(v, scale):
    return [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in v]


def nearest(v, centres):
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))


def long(x):
    return x if abs(x) < 1 << 63 else None


def moved(centres, points, found):
    out = []
    for k, old in enumerate(centres):
        own = [p for p, (_, c) in zip(points, found) if c == k]
        out.append([sum(x) // len(own) for x in zip(*own)] if own else old)
    return out


def brute_clusters(rows, k, rounds, scale, dim):
    rows = kept(rows, dim)
    points = [whole(v, scale) for _, v, _ in rows]
    digest = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [whole(r[1], scale) for r in sorted(rows, key=digest)[:k]]
    for _ in range(rounds):
        centres = moved(centres, points, [nearest(p, centres) for p in points])
    found = [nearest(p, centres) for p in points]
    return [(r[0], c, d) for r, (d, c) in zip(rows, found)], centres


def first():
    return F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)


def odd(rows, dim):
    """Rows that do not count, rows that repeat, null ids."""
    good = rows[0][1]
    return [*rows, (1000, None, 1), (1001, [], 1), (1002, good[:-1], 1), (1003, [*good[:-1], None], 1), (1004, [*good[:-1], NAN], 2), (1005, [*good[:-1], INF], 2),
            (1006, [0.0] * dim, None), (1007, [-0.0] * dim, 1), (None, good, 1), (None, None, None), rows[1], rows[1], (5, rows[2][1], 3)]


@pytest.mark.parametrize("dim,n", [(8, 300), (3, 40), (1, 30)])
def test_clusters(spark, dim, n):
    rows = odd(rows_of(random.Random(dim), n, dim), dim)
    got, centres = centroids.clustered(frame(spark, rows), k=6, rounds=3, scale=64, dim=dim, first=first())
    want, of = brute_clusters(rows, 6, 3, 64, dim)
    assert centres == of
    assert same(got.collect(), want)
    full = centroids.with_totals(got, centres).collect()
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    assert same([(r[0], r[1], r[2], r[3], r[4]) for r in full], [(*w, sums[w[1]], sum(sums.values())) for w in want])
    assert all(r[5] == hashlib.sha256(",".join(map(str, of[r[1]])).encode()).hexdigest() for r in full)


def test_clusters_of_few_equal_and_far_points(spark):
    point = [0.1, 0.2, 0.3]
    for rows in ([], [(1, point, None)], [(i, point, None) for i in range(9)], [(i, [float(i // 3), 0.0, 0.0], None) for i in range(9)]):
        got, centres = centroids.clustered(frame(spark, rows), k=4, rounds=2, dim=3, first=first())
        want, of = brute_clusters(rows, 4, 2, 64, 3)
        assert centres == of and same(got.collect(), want)
        assert centroids.with_totals(got, centres).count() == len(rows)
    wide = [(i, [x * 10.0 ** (i % 5 * 3) for x in v], None) for i, v, _ in rows_of(random.Random(1), 60, 3)] + [(100, [3e38, 1e9, 0.0], None), (101, [-3e38, 2e9, 1.0], None)]
    wide = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in wide]
    got, centres = centroids.clustered(frame(spark, wide), k=5, rounds=3, dim=3, first=first())
    want, of = brute_clusters(wide, 5, 3, 64, 3)
    assert centres == of and same(got.collect(), [(i, c, long(d)) for i, c, d in want])
    full = centroids.with_totals(got, centres).collect()
    assert len(full) == 62 and all(r["inertia"] is None for r in full) == any(abs(d) >= 1 << 63 for _, _, d in want)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 20, (12, 32))
    x = np.floor(middle[rng.integers(0, 12, 4000)] + rng.normal(0, 2, (4000, 32))).astype(np.int64)
    centres = np.floor(middle).astype(np.int64)
    simplex = centroids.Simplex(x[:40])
    assert len(simplex.pivots) == centroids.PIVOTS
    may = simplex.candidates(simplex.distances(x), simplex.distances(centres))
    true = np.stack([centroids.squared(x, c) for c in centres], axis=1)
    assert may[np.arange(len(x)), true.argmin(axis=1)].all()
    assert (may | (true > true.min(axis=1, keepdims=True))).all()
    assert may.mean() < 0.5
    # the bounds themselves
    (p, h), (q, g) = simplex.apex(simplex.distances(x).astype(float)), simplex.apex(simplex.distances(centres).astype(float))
    base = ((p[:, None] - q[None]) ** 2).sum(axis=2)
    assert (base + (h[:, None] - g) ** 2 <= true + 1e-6).all() and (base + (h[:, None] + g) ** 2 >= true - 1e-6).all()


def test_equal_and_flat_pivots():
    simplex = centroids.Simplex(np.array([[0, 0, 0], [0, 0, 0], [4, 0, 0], [8, 0, 0], [0, 4, 0], [2, 2, 0]]))
    assert simplex.pivots.tolist() == [[0, 0, 0], [4, 0, 0], [0, 4, 0]]


def brute_codes(rows, parts, entries, rounds, scale, dim):
    rows, wide = kept(rows, dim), dim // parts
    points = [whole(v, scale) for _, v, _ in rows]
    cut = lambda v, p: v[p * wide: (p + 1) * wide]
    starts = [whole(r[1], scale) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[cut(s, p) for s in starts] for p in range(parts)]
    for r in range(rounds + 1):
        found = [[nearest(cut(v, p), books[p]) for v in points] for p in range(parts)]
        if r < rounds:
            books = [moved(books[p], [cut(v, p) for v in points], found[p]) for p in range(parts)]
    return [(r[0], r[2], "".join(f"{found[p][k][1]:02x}" for p in range(parts)), sum(found[p][k][0] for p in range(parts))) for k, r in enumerate(rows)], books


@pytest.mark.parametrize("dim,parts,block", [(8, 4, 8192), (6, 2, 50), (4, 4, 7)])
def test_codes(spark, dim, parts, block):
    rows = odd(rows_of(random.Random(dim), 200, dim), dim)
    got, books = vector_codes.coded(frame(spark, rows), parts, 16, 2, 256, dim, block_rows=block)
    want, of = brute_codes(rows, parts, 16, 2, 256, dim)
    assert books == of
    assert same(got.collect(), want)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    full = vector_codes.with_totals(got, books)
    digest = hashlib.sha256(",".join(str(x) for b in of for e in b for x in e).encode()).hexdigest()
    assert same(full.collect(), [(*w, sums[w[1]], digest) for w in want])


def test_codes_of_few_and_wide_rows(spark):
    for rows in ([], [(1, [0.5] * 4, 2)], [(i, [0.5] * 4, None) for i in range(5)]):
        got, books = vector_codes.coded(frame(spark, rows), 2, 4, 2, 256, 4)
        want, of = brute_codes(rows, 2, 4, 2, 256, 4)
        assert books == of and same(got.collect(), want)
        assert vector_codes.with_totals(got, books).count() == len(rows)
    wide = [(i, [float(np.float32(x * 10.0 ** (i % 7 * 3))) for x in v], y) for i, v, y in rows_of(random.Random(2), 50, 4)]
    wide += [(60, [3e38, 0.0, 1.0, -2.5e38], 1)]
    wide = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in wide]
    got, books = vector_codes.coded(frame(spark, wide), 2, 8, 2, 256, 4)
    want, of = brute_codes(wide, 2, 8, 2, 256, 4)
    assert books == of and same(got.collect(), [(*w[:3], long(w[3])) for w in want])


def test_whole_numbers_and_sums(spark):
    x = np.array([[0.5, -0.5, -1e-9], [2.0 ** 60, -2.0 ** 60 - 512, 1e300]])
    assert vectors.whole(x[:1], 64).tolist() == [[32, -32, -1]]
    assert vectors.whole(x, 64).tolist() == [[32, -32, -1], [64 * int(a) for a in x[1]]]
    totals = {0: (3, [5, -7, 0, 1 << 90, -(1 << 90) - 12345, -(1 << 40)]), 4: (1, [-(1 << 39)])}
    rows = spark.createDataFrame(vectors.sum_rows(totals).to_pandas(), vectors.SUMS)
    assert vectors.added(rows.union(rows)) == {s: {p: 2 * v for p, v in enumerate([n, *sums], -1)} for s, (n, sums) in totals.items()}


def brute_links(rows, least):
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        m, n = max(map(abs, a)), max(map(abs, b))
        a, b = [x / m for x in a], [x / n for x in b]
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    n, root = len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if good(a) and good(b) and len(a) == len(b) and (a == b or cosine(a, b) >= least):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    ids = {}
    for i in range(n):
        ids.setdefault(top(i), []).append(rows[i][0])
    return [(rows[i][0], links[i], min((x for x in ids[top(i)] if x is not None), default=None)) for i in range(n)]


def groups(rng, dim, sizes, near=0.02):
    rows, at = [], 0
    for size in sizes:
        middle = [rng.gauss(0, 1) for _ in range(dim)]
        for _ in range(size):
            rows.append((at, [float(np.float32(x + rng.gauss(0, near))) for x in middle], 0))
            at += 1
    return rows


@pytest.mark.parametrize("dim,block,near", [(64, 4096, 0.1), (64, 70, 0.2), (5, 40, 0.15), (2, 64, 0.05), (1, 64, 0.1)])
def test_links(spark, dim, block, near):
    rng = random.Random(block + dim)
    rows = odd(groups(rng, dim, [90, 1, 2, 30, *[1] * 60], near) + [(500, [1e-30] * dim, 0), (501, [2e30] * dim, 0), (502, [-1.0] * dim, 0)], dim)
    rows += [(600 + i, [1.0, 2.0, 3.0 + i / 50, 4.0, 5.0, 6.0, 7.0], 0) for i in range(20)] + [(700 + i, rows[0][1], 0) for i in range(50)]
    got = grid_order.near_vectors(frame(spark, rows), least=0.95, block_rows=block)
    want = brute_links(rows, 0.95)
    assert same(got.collect(), want)
    assert any(w[1] > 5 for w in want)


def test_links_of_doubles_nothing_and_equal_rows(spark):
    doubles = SCHEMA.replace("array<float>", "array<double>")
    assert grid_order.near_vectors(frame(spark, []), 0.95).count() == 0
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (None, [1e200, 1e200], 0), (4, [1e-300, 1e-300], 0), (None, [1.0, 1.0], 0), (6, [1.0, -1.0], 0), (None, [5.0], 0), (7, [1.0, 1.0], 0), (7, [1.0, 1.0], 0)]
    for least in (0.95, 1.0, 1e-6):
        got = grid_order.near_vectors(frame(spark, rows, doubles), least).collect()
        if least == 0.95:
            assert same(got, brute_links(rows, least))
        assert len(got) == len(rows)


def test_distant_blocks_and_leaves_are_skipped(spark):
    rng = random.Random(9)
    rows = groups(rng, 16, [40] * 30, 0.03)
    x = np.array([r[1] for r in rows])
    unit = grid_order.units(x)
    basis = grid_order.principal(unit, 8)
    order = np.lexsort(np.floor(unit @ basis / 0.3162).T[::-1])
    seq = grid_order.Sequence(x[order], basis, 8)
    i, _ = grid_order.near_leaves(seq, seq, True, 0.1)
    leaves = len(seq.boxes[0][0])
    assert len(i) < 0.7 * leaves * (leaves + 1) / 2
    assert same(grid_order.near_vectors(frame(spark, rows), block_rows=64).collect(), brute_links(rows, 0.95))


def test_cosines_at_the_limit(spark):
    # 3-4-5 triangles: a cosine of exactly 0.8 and 0.6
    rows = [(1, [5.0, 0.0], 0), (2, [4.0, 3.0], 0), (3, [0.0, 1.0], 0)]
    assert same(grid_order.near_vectors(frame(spark, rows), 0.8).collect(), [(1, 1, 1), (2, 1, 1), (3, 0, 3)])
    assert same(grid_order.near_vectors(frame(spark, rows), 0.6).collect(), [(1, 1, 1), (2, 2, 1), (3, 1, 1)])
