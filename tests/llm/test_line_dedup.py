import random
import re

import numpy as np
from pyspark.sql import functions as F

from llm.conftest import EDGES, frame, same
from loomwork.llm.line_dedup import PerfectHash, Shard, drop_shared_lines

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(UPPER)


def brute(rows, min_chars=20, min_docs=3):
    holders = {}
    for at, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append((i is not None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(holders.get(key(x), [])) >= min_docs and (i is not None, i or 0) != max(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def got(df, **how):
    return drop_shared_lines(df, **how).select("doc_id", "__n_lines", "__n_dropped", "__kept").collect()


def rows(n, seed=5):
    rng = random.Random(seed)
    pool = [f"  This is Shared line number {k} of them\t" if k % 2 else f"this is shared LINE number {k} of thém" for k in range(30)] + ["short", "", "Ünïcode line of twenty ch"]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {rng.random()} of document {i}" for _ in range(rng.randint(1, 12)))) for i in range(n)]


def test_against_brute_force(spark):
    data = rows(150) + [(150 + i, "the one line that a third of all documents has\nmine " + "x" * 20 + str(i)) for i in range(80)]
    assert same(got(frame(spark, data)), brute(data))
    # many small shards, each copied to several tasks
    assert same(got(frame(spark, data), shard_keys=20, task_probes=5), brute(data))


def test_edge_rows(spark):
    line = "a line of more than twenty characters"
    data = [*EDGES, (None, line), (None, line + "\nx"), (30, line), (30, line), (31, f"{line}\n {line.upper()}\n{line}\n"), (32, "é" * 20), (33, "É" * 20), (34, "é" * 20), (35, "é" * 20), (36, "e" * 19)]
    assert same(got(frame(spark, data)), brute(data))
    only_null = [(None, line), (None, line + "\nx"), (None, line)]
    assert same(got(frame(spark, only_null)), brute(only_null))
    assert got(frame(spark, [])) == []


def test_all_columns_stay(spark):
    df = frame(spark, rows(20))
    assert drop_shared_lines(df).drop("__n_lines", "__n_dropped", "__kept").columns == df.columns
    assert drop_shared_lines(df).where(F.col("score") == "own").count() == 20


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 30000).astype(np.uint64))
    h = PerfectHash.of(keys)
    assert sorted(h.numbers(keys).tolist()) == list(range(len(keys)))
    assert sum(map(len, h.levels)) < 8 * len(keys)


def test_shard_tells_twins_and_strangers_apart():
    h1, h2 = np.array([5, 5, 9], np.uint64), np.array([1 << 40, 2 << 40, 3 << 40], np.uint64)
    shard = Shard.loaded(Shard.of(h1, h2, np.array([3, 1, 7]), np.array([8, 8, 4]), np.array([True, True, False])).dumped())
    ask = lambda a, b, i, has=True: bool(shard.dropped(np.array([a], np.uint64), np.array([b], np.uint64), np.array([i]), np.array([has]), 3)[0])
    assert ask(5, 1 << 40, 7) and not ask(5, 1 << 40, 8) and not ask(5, 2 << 40, 7)
    assert ask(9, 3 << 40, 4) and not ask(9, 3 << 40, 0, False)  # the last holder has no id
    assert not ask(9, 4 << 40, 1) and not ask(77, 1, 1)
