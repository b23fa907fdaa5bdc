"""Ordered work on a hot key gives what a plain window gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import hot


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 1 holds about a third of the rows; one time value fills a tenth; nulls in the key."""
    df = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 10 == 0, 500).otherwise((F.col("id") * 7919) % 1000).alias("t"),
        (F.col("id") % 11).alias("v"),
        F.concat(F.lit("n"), (F.col("id") % 17).cast("string")).alias("s"))
    return df.cache()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "id"], ["s", "-id"], ["-id"]])
def test_numbered(skewed, order):
    got = hot.numbered(skewed, ["k"], order, "rn", rows=100)
    w = Window.partitionBy("k").orderBy(*hot.sort_columns(order))
    want = skewed.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert same(got.select("id", "rn"), want.select("id", "rn"))


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "-id"], ["s", "id"]])
def test_numbered_whole_table(skewed, order):
    got = hot.numbered(skewed, [], order, "rn", rows=100)
    want = skewed.withColumn("rn", F.row_number().over(Window.orderBy(*hot.sort_columns(order))).cast("bigint"))
    assert same(got.select("id", "rn"), want.select("id", "rn"))


def test_a_hot_key_is_cut_into_slices(skewed):
    found = hot.crowded(skewed, ["k"], rows=100)
    assert {r[0] for r in found.table.collect()} == {1} and found.rows == 1000 + skewed.where("id % 3 <> 0 and id % 50 <> 1 and id % 40 = 1").count()
    assert hot.crowded(skewed, ["k"], rows=5000) is None
    rest, heavy = found.split(skewed, ["k"])
    assert rest.count() + heavy.count() == 3000 and rest.where("k is null").count() > 0
    s = hot.sliced(heavy, ["k"], ["t", "id"], found.rows, 100)
    sizes = s.df.groupBy("__slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 200 and sizes.count() >= 8


def test_any_number_of_crowded_keys(spark):
    """20 000 keys, each above the limit: none is missed, and the shape of a list follows from its length alone."""
    df = spark.range(400_000).select((F.col("id") % 20_000).alias("k"), "id")
    assert hot.crowded(df, ["k"], rows=19).lines == 20_000
    parts = hot.collect_ordered(df, ["k"], ["id"], F.col("id"), per_row=8)
    shape = parts.groupBy("k").agg(F.sort_array(F.collect_list(F.size("items"))).alias("n")).groupBy("n").count().collect()
    assert [(list(r[0]), r[1]) for r in shape] == [([4, 8, 8], 20_000)]
    values = hot.collect_values(df.withColumn("s", F.lit("x")), ["k"], {"s": False}, per_row=8)
    shape = values.groupBy("k").agg(F.sort_array(F.collect_list(F.size("s"))).alias("n")).groupBy("n").count().collect()
    assert [(list(r[0]), r[1]) for r in shape] == [([4, 8, 8], 20_000)]


@pytest.mark.parametrize("order", [["s", "id"], ["-s", "id"], ["d", "-id"], ["-d", "id"]])
def test_slices_are_even_whatever_the_order(spark, order):
    """Long common prefixes, infinities, NaN and nulls."""
    d = F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 11 == 0, float("inf")).when(F.col("id") % 13 == 0, float("-inf")).when(F.col("id") % 17 != 0, F.col("id") * -0.5)
    df = spark.range(20_000).select("id", d.alias("d"), F.when(F.col("id") % 19 != 0, F.concat(F.lit("a long common prefix of text "), (F.col("id") % 500).cast("string"))).alias("s"))
    s = hot.sliced(df, [], order, 20_000, 500)
    assert s.df.groupBy("__slice").count().agg(F.max("count")).first()[0] <= 1000
    got = hot.numbered(df, [], order, "rn", rows=500)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(*hot.sort_columns(order))).cast("bigint"))
    assert same(got.select("id", "rn"), want.select("id", "rn"))


def test_running_sum(skewed):
    got = hot.running_sum(skewed, ["k"], ["t", "id"], "v", "total", rows=100)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("total", F.sum("v").over(w))
    assert same(got.select("id", "total"), want.select("id", "total"))


def test_fill_forward(skewed):
    holes = skewed.withColumn("x", F.when(F.col("v") == 0, F.col("id")))
    got = hot.fill_forward(holes, ["k"], ["t", "id"], "x", rows=100)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = holes.withColumn("x", F.last("x", ignorenulls=True).over(w))
    assert same(got.select("id", "x"), want.select("id", "x"))


def test_neighbours(skewed):
    def make(w):
        return {"p": F.lag("id", 2).over(w), "n": F.lead("id").over(w)}
    got = hot.neighbours(skewed, ["k"], ["t", "id"], make, back=2, ahead=1, rows=100)
    want = skewed.withColumns(make(Window.partitionBy("k").orderBy("t", "id")))
    assert same(got.select("id", "p", "n"), want.select("id", "p", "n"))


def test_collect_ordered_parts(skewed):
    whole = hot.collect_ordered(skewed, ["k"], ["t", "id"], F.col("id"))
    parts = hot.collect_ordered(skewed, ["k"], ["t", "id"], F.col("id"), per_row=100)
    assert parts.agg(F.max(F.size("items"))).first()[0] == 100
    joined = {}
    for k, part, items in sorted(map(tuple, parts.collect()), key=repr):
        joined.setdefault(k, {})[part] = items
    for k, part, items in whole.collect():
        assert part == 0
        assert [x for p in sorted(joined[k]) for x in joined[k][p]] == items


def test_collect_values_parts(skewed):
    lists = {"s": False, "t": True}
    text = skewed.withColumn("t", F.col("t").cast("string"))
    whole = {r[0]: r for r in hot.collect_values(text, ["k"], lists).collect()}
    parts = hot.collect_values(text, ["k"], lists, per_row=60).collect()
    assert max(len(r.s) for r in parts) <= 60
    for k, r in whole.items():
        mine = sorted((p for p in parts if p.k == k), key=lambda p: p.part_no)
        assert [x for p in mine for x in p.s] == list(r.s)
        assert [x for p in mine for x in p.t] == list(r.t)
        assert {p.n_rows for p in mine} == {r.n_rows}
