import random
import re

from llm.conftest import EDGES, frame, same
from loomwork.llm.decontaminate import contained_items, without_items


def shingles(t):
    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    return [(i, j, len(a & b), len(b)) for i, t in docs for a in [shingles(t)] for j, u in items for b in [shingles(u)] if b and 100 * len(a & b) >= 80 * len(b)]


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "own", 3) for i, t in items], "item_id long, text string, sketch string, n int")


def data(seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 8, 20, 40, 60])))) for k in range(25)] + [(90, None), (91, "..."), (92, "one"), (None, "an item whose id is null but has words"), (0, "w1 w2 w3 w4 w5 w6 w7")]
    docs = []
    for i in range(80):
        w = [rng.choice(words) for _ in range(rng.choice([0, 4, 30, 400]))]
        if i % 2 == 0:  # an item, somewhat changed, inside a longer text
            x = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if x:
                    x[rng.randrange(len(x))] = "changed"
            w[len(w) // 2: len(w) // 2] = x
        docs.append((i, " ".join(x.upper() if i % 3 == 0 else x + "," for x in w)))
    return docs + EDGES + [(200, "one"), (201, "An item - whose id is NULL, but has words"), (201, "An item - whose id is NULL, but has words")], items


def test_against_brute_force(spark):
    docs, items = data()
    want = brute(docs, items)
    assert len(want) > 10
    got = contained_items(frame(spark, docs), items_frame(spark, items)).select("id", "item", "shared", "n").collect()
    assert same(got, want)


def test_documents_without_items_stay(spark):
    docs, items = data(7)
    df = frame(spark, docs)
    left = without_items(df, items_frame(spark, items))
    assert left.columns == df.columns
    hit = {(i, t) for i, t in docs if brute([(i, t)], items)}
    assert hit and same([(r.doc_id, r.text) for r in left.collect()], [d for d in docs if d not in hit])


def test_empty_tables(spark):
    docs, items = data()
    assert contained_items(frame(spark, []), items_frame(spark, items)).count() == 0
    assert contained_items(frame(spark, docs), items_frame(spark, [])).count() == 0
    assert without_items(frame(spark, EDGES), items_frame(spark, [])).count() == len(EDGES)
