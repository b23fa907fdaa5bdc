"""With a small limit, lists go on in further parts; the SQL says the same at every size."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

from compare import compare, duck  # noqa: E402

from loomwork.catalog import ORACLE, QUERIES  # noqa: E402
from loomwork.catalog.delay_data import answers_wide  # noqa: E402
from loomwork.operators import hot  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LISTS = ["token_analysis", "token_analysis_uprn", "token_rollup", "collect_list_set", "string_agg", "group_members", "errors_by_kind", "peer_concat", "transpose", "map_transform"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("limit", [1, 3, 10])
@pytest.mark.parametrize("name", LISTS)
def test_lists_in_parts(spark, monkeypatch, name, limit):
    monkeypatch.setattr(hot, "LIST_ROWS", limit)
    sql = ORACLE[name].replace(f"// {100_000}", f"// {limit}")
    assert sql != ORACLE[name]
    ok, message, _ = compare(spark, duck(FOLDER), QUERIES[name], sql, FOLDER)
    assert ok, message


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["running_total", "take_until_sum"])
def test_sums_of_hot_keys(spark, monkeypatch, name):
    """The spread way on every key: the same sums, and the same rows taken."""
    both, seen = hot._both, []
    monkeypatch.setattr(hot, "_both", lambda df, keys, order, rows, plain, spread: (seen.append(1), both(df, keys, order, 5, plain, spread))[1])
    ok, message, _ = compare(spark, duck(FOLDER), QUERIES[name], ORACLE[name], FOLDER)
    assert ok and seen, message


def test_an_answer_of_many_parts_is_whole(spark, monkeypatch):
    monkeypatch.setattr(hot, "LIST_ROWS", 4)
    df = spark.range(25).selectExpr("'p' as product", "if(id % 5 = 0, 'Advanced', 'Premium') as svr", "id as answer_id", "concat('a', id) as answer_text", "if(id = 7, 'N', 'Y') as flag")
    got = answers_wide(df.repartition(3)).collect()
    text = lambda ids: ";".join(f"a{i}" for i in ids)
    assert [tuple(r) for r in got] == [("p", text(i for i in range(25) if i % 5 and i != 7), text(range(0, 25, 5)))]
    assert answers_wide(df.where("svr = 'Premium'")).select(F.col("answer_advanced").isNull()).first()[0]
