import random
import re

import numpy as np

from llm.conftest import EDGES, frame, same
from loomwork.llm import outliers


def base(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    again = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n


def corpus(n=260, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))]
        if i % 11 == 0:
            words = [w + "###" for w in words]
        if i % 13 == 0:
            words[10:10] = words[:6]
        text = " ".join(words)
        if i % 7 == 0:
            text = "same line\n" * 4 + text
        out.append((i, text, "en" if i % 3 else "de", "a" if i % 2 else "b"))
    return out


def estimate(x):
    """The same steps in numpy: centre and covariance of one group."""
    x = x / outliers.GRID
    n = len(x)
    at = lambda share: np.sort(x, axis=0)[int(np.ceil(share * n)) - 1]
    mean, cov = at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2)
    correct = outliers.CORE / outliers.chi2_share(outliers.chi2_cut(outliers.CORE, outliers.DIM), outliers.DIM + 2)
    floors = np.diag(np.array(outliers.FLOORS) ** 2)
    far = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floors), x - mean)
    for _ in range(outliers.STEPS):
        cls = np.floor(64 * np.log(far() + 1e-3))
        core = np.array([(cls < c).sum() for c in cls]) < np.ceil(outliers.CORE * n)
        mean, cov = x[core].mean(axis=0), np.cov(x[core].T, bias=True) * correct
    return far()


def transformed(b):
    n = max(1, b[0])
    return np.round(np.log1p([b[0], b[1] / n, b[2] / n, 5 * b[3] / n, b[4] / n]) * outliers.GRID)


def test_base_counts(spark):
    rows = corpus(60) + [(300 + k, t, "en", "a") for k, t in enumerate(["a b c d e " * 9, "x " * 40, "a b c d e f a b c d e g h i j k l m n", "a\n a\na\n\n\n", "#*$%&|<> é\x0b日本"])] + [(*e, "en", "a") for e in EDGES]
    got = outliers.judged(frame(spark, rows)).select("doc_id", "n_words", *outliers.BASE, "base_failed").collect()
    assert same(got, [(r[0], *base(r[1])) for r in rows])


def test_estimates_against_numpy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in outliers.judged(frame(spark, rows)).collect()}
    stats = [base(r[1]) for r in rows]
    groups = {}
    for r, b in zip(rows, stats):
        if not b[5]:
            groups.setdefault(r[2:], []).append((r[0], transformed(b)))
    # groups under the least size are pooled by language here
    pools = {}
    for key, members in groups.items():
        pools.setdefault(key if len(members) >= outliers.LEAST_ROWS else key[:1], []).extend(members)
    assert any(len(k) == 1 for k in pools) and any(len(k) == 2 for k in pools)
    cut = outliers.chi2_cut(1 - outliers.TAIL, outliers.DIM)
    for members in pools.values():
        assert len(members) >= outliers.LEAST_ROWS
        for (i, _), d in zip(members, estimate(np.array([x for _, x in members]))):
            assert abs(got[i].distance - d) < 1e-6 * (1 + d) and got[i].kept == (d <= cut)
    marked = [i for i in range(len(rows)) if i % 11 == 0 and not stats[i][5]]
    assert not any(got[i].kept for i in marked)
    assert sum(got[i].kept for i in range(len(rows)) if i % 11 and not stats[i][5]) > 0.95 * sum(1 for i in range(len(rows)) if i % 11 and not stats[i][5])


def test_small_and_null_groups(spark):
    rows = [(i, f"ten words or more stand in this text of number {i} here", None if i % 2 else "en", None if i % 3 else "a") for i in range(20)] + [(*e, None, None) for e in EDGES]
    got = outliers.judged(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.kept != r.base_failed and r.distance is None for r in got)
    assert outliers.judged(frame(spark, [])).count() == 0


def test_a_third_of_junk_copies_is_rejected(spark):
    clean = [(i, t, "en", "a") for i, t, *_ in corpus(400) if i % 11 and i % 7 and i % 13]
    junk = " ".join(f"word{i} ###" for i in range(60))
    for near in (False, True):
        rows = clean + [(1000 + k, junk + " more" * (k % 4 if near else 0), "en", "a") for k in range(len(clean) // 2)]
        got = outliers.judged(frame(spark, rows)).collect()
        assert not any(r.kept for r in got if r.doc_id >= 1000) and not any(r.base_failed for r in got)
        assert sum(r.kept for r in got if r.doc_id < 1000) > 0.95 * len(clean)


def test_chi_square():
    assert abs(outliers.chi2_cut(0.95, 5) - 11.0705) < 1e-3 and abs(outliers.chi2_share(4.3515, 5) - 0.5) < 1e-4
