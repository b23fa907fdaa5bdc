import zlib

import numpy as np

from llm.conftest import EDGES, frame, same
from loomwork.llm import quality_fm as fm


def test_the_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    x, w, v = rng.normal(size=(5, 7)), rng.normal(size=7), rng.normal(size=(7, 3))
    slow = [0.5 + x[r] @ w + sum(v[i] @ v[j] * x[r, i] * x[r, j] for i in range(7) for j in range(i)) for r in range(5)]
    assert np.allclose(fm.margin(x, 0.5, w, v), slow)


def test_interactions_are_learnt():
    rng = np.random.default_rng(2)
    x = rng.choice([-1.0, 1.0], size=(2000, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no single input tells anything
    model = fm.fit(np.concatenate([np.zeros((2000, 0)), x], axis=1)[:1500], y[:1500], 0.5, fm.Model(0, (), 0.5))
    assert ((model.scores(x[1500:]) > 0.5) == (y[1500:] == 1)).mean() > 0.95


def docs_and_labels(spark, n=200):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        words = [f"word{(i * 7 + k * 3) % 53}" for k in range(30 + i % 40)]
        rows.append((i, " ".join(words) + "." if good else "&&& ".join(words)))
        labels.append((i, int(good)))
    return rows, labels, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_are_told_apart(spark):
    rows, labels, table = docs_and_labels(spark)
    df = frame(spark, rows)
    scores = {r.doc_id: r.score for r in fm.scored(df, fm.train(df, table)).selectExpr("doc_id", "__score as score").collect()}
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 20 and all((scores[i] >= 0.3) == bool(dict(labels)[i]) for i in out)
    got = {r.doc_id: r.h for r in df.select("doc_id", fm.held_out(df.doc_id).alias("h")).collect()}
    assert got == {i: i in out for i, _ in labels}


def test_held_out_labels_are_not_read(spark):
    rows, labels, table = docs_and_labels(spark, 80)
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, quality int")
    df = frame(spark, rows)
    a, b = fm.train(df, table, buckets=64), fm.train(df, turned, buckets=64)
    assert (a.weight == b.weight).all() and a.bias == b.bias and a.prior == b.prior


def test_edge_rows_and_labels(spark):
    rows, labels, _ = docs_and_labels(spark, 60)
    labels += [(0, 0), (4, None), (None, 1), (5, 1), (777, 0), (3, 2)]  # contradicting, null, unknown id, no label
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    df = frame(spark, rows + EDGES)
    out = fm.scored(df, fm.train(df, table, buckets=64))
    assert out.columns == [*df.columns, "__score"]
    got = out.collect()
    assert same([(r.doc_id,) for r in got], [(i,) for i, _ in rows + EDGES]) and all(0 <= r["__score"] <= 1 for r in got)


def test_without_labels_or_rows(spark):
    df = frame(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r[0] for r in fm.scored(df, fm.train(df, none)).select("__score").collect()} == {0.5}
    ones = spark.createDataFrame([(k, 1) for k in range(1, 9)], "doc_id long, quality int")
    model = fm.train(df, ones)
    assert model.weight is None and model.prior > 0.8
    _, _, table = docs_and_labels(spark, 40)
    assert fm.scored(frame(spark, []), fm.train(frame(spark, []), table)).count() == 0
