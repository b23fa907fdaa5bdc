"""As-of joins, interval joins, percentiles and grouping sets against brute force, with one key that holds a third of the rows."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import grouping, hot, intervals, sketches
from loomwork.operators.asof import asof_join
from loomwork.operators.percentiles import exact_percentiles
from loomwork.operators.ranks import ranked


def same(a, b):
    return sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def timed(rng, n, spread):
    """(key, time, id): key 1 holds a third, some keys and times are null, times repeat."""
    return [(1 if i % 3 == 0 else None if i % 41 == 0 else rng.randrange(8), None if i % 37 == 0 else rng.randrange(spread), i) for i in range(n)]


def brute_asof(left, right, direction, tolerance, exact):
    out = []
    for k, t, i in left:
        best = None
        if k is not None and t is not None:
            for k2, t2, j in right:
                if k2 != k or t2 is None or (t2 == t and not exact):
                    continue
                far = t - t2
                if direction == "backward" and far < 0 or direction == "forward" and far > 0:
                    continue
                # backward: the largest tie; forward: the smallest; nearest: backward first
                rank = (abs(far), far < 0, -j if far >= 0 and not (direction == "forward") else j)
                if best is None or rank < best[0]:
                    best = (rank, j, t2)
        if best and (tolerance is None or best[0][0] <= tolerance):
            out.append((k, t, i, best[1], best[2]))
        else:
            out.append((k, t, i, None, None))
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact,tolerance,limit", [(True, None, 10**6), (False, 3, 10**6), (True, 5, 50), (False, None, 50)])
def test_asof(spark, direction, exact, tolerance, limit):
    rng = random.Random(4)
    left, right = timed(rng, 400, 300), timed(rng, 250, 300)
    a = spark.createDataFrame(left, "k int, t long, id long").repartition(3)
    b = spark.createDataFrame(right, "kr int, u long, other long").repartition(3)
    got = asof_join(a, b, [("k", "kr")], "t", "u", {"other": "other", "at": "u"}, direction, None if tolerance is None else F.lit(tolerance), exact, ["other"], rows=limit)
    assert got.columns == ["k", "t", "id", "other", "at"]
    assert same(got.collect(), brute_asof(left, right, direction, tolerance, exact))


def test_asof_of_empty_sides_repeated_rows_and_times(spark):
    at = datetime.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, at, "x"), (1, at, "x"), (2, None, "y")], "k int, t timestamp, v string")
    right = spark.createDataFrame([(1, at - datetime.timedelta(minutes=5), 7)], "k int, t timestamp, w int")
    none = right.limit(0)
    assert same(asof_join(left, none, ["k"], "t", "t", ["w"]).select("v", "w").collect(), [("x", None), ("x", None), ("y", None)])
    assert asof_join(left.limit(0), right, ["k"], "t", "t", ["w"]).count() == 0
    assert same(asof_join(left, right, ["k"], "t", "t", ["w"], tolerance=F.expr("interval 5 minutes")).select("v", "w").collect(), [("x", 7), ("x", 7), ("y", None)])
    assert same(asof_join(left, right, ["k"], "t", "t", ["w"], tolerance=F.expr("interval 299 seconds")).select("v", "w").collect(), [("x", None), ("x", None), ("y", None)])
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "t", "t", ["t"])
    # without keys, and all left rows at one time
    many = spark.range(500).select(F.lit(10).alias("t"), "id")
    out = asof_join(many, spark.range(20).select((F.col("id") % 9).alias("u"), F.col("id").alias("w")), [], "t", "u", ["w"], tie=["w"], rows=40)
    assert out.count() == 500 and {r[0] for r in out.select("w").distinct().collect()} == {17}


def test_asof_pairs_nothing(spark):
    a = spark.range(100).selectExpr("id % 2 as k", "id as t")
    plan = asof_join(a, a.withColumnsRenamed({"t": "u"}), ["k"], "t", "u", ["u"])._jdf.queryExecution().toString()
    assert "Join" not in plan


def ranges(rng, n, width, long_share=3):
    """(key, low, high, id): every third covers a third of the axis; some are points, some turned round, some null."""
    out = []
    for i in range(n):
        low = rng.randrange(10000)
        high = low + (3400 if i % long_share == 0 else 0 if i % 7 == 0 else rng.randrange(width))
        if i % 23 == 0:
            low, high = high + 1, low
        out.append((None if i % 29 == 0 else rng.randrange(3), None if i % 31 == 0 else low, None if i % 37 == 0 else high, i))
    return out


@pytest.mark.parametrize("bin_rows", [10**6, 40, 1])
@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
def test_overlaps(spark, bin_rows, closed, keyed):
    rng = random.Random(6)
    left, right = ranges(rng, 300, 60), ranges(rng, 200, 400)
    a = spark.createDataFrame(left, "ka int, la long, ha long, a int").repartition(3)
    b = spark.createDataFrame(right, "kb int, lb long, hb long, b int").repartition(3)
    got = intervals.overlap_join(a, b, ("la", "ha"), ("lb", "hb"), [("ka", "kb")] if keyed else [], closed, bin_rows)
    assert got.columns == [*a.columns, *b.columns]

    def whole(r):
        return None not in r[1:3] and (r[1] <= r[2] if closed else r[1] < r[2])

    want = [(x[3], y[3]) for x in left for y in right if whole(x) and whole(y) and (not keyed or (x[0] == y[0] and x[0] is not None))
            and (x[1] <= y[2] and y[1] <= x[2] if closed else x[1] < y[2] and y[1] < x[2])]
    assert same(got.select("a", "b").collect(), want) and len(want) > 1000


@pytest.mark.parametrize("bin_rows", [10**6, 30])
def test_points_in_ranges(spark, bin_rows):
    rng = random.Random(7)
    points = [(None if i % 19 == 0 else rng.choice([rng.randrange(14000) / 2, 500.0, -1e300, float("inf")]), i) for i in range(400)] * 2
    spans = ranges(rng, 250, 100)
    p = spark.createDataFrame(points, "x double, p int").repartition(3)
    r = spark.createDataFrame(spans, "k int, low long, high long, r int").repartition(3)
    got = intervals.range_join(p, r, "x", "low", "high", bin_rows=bin_rows)
    want = [(i, s[3]) for x, i in points for s in spans if x is not None and None not in s[1:3] and s[1] <= x <= s[2]]
    assert same(got.select("p", "r").collect(), want)
    assert intervals.range_join(p.limit(0), r, "x", "low", "high", bin_rows=bin_rows).count() == 0


def test_dates_and_a_range_over_a_third_of_the_bins(spark):
    days = spark.range(4000).selectExpr("date_add(date'2000-01-01', cast(id as int)) as d")
    spans = spark.createDataFrame([(datetime.date(2001, 1, 1), datetime.date(2004, 8, 1), 1), (datetime.date(2002, 2, 2), datetime.date(2002, 2, 2), 2)], "a date, b date, s int")
    got = intervals.range_join(days, spans, "d", "a", "b", bin_rows=1).groupBy("s").count().collect()
    assert same(got, [(1, (datetime.date(2004, 8, 1) - datetime.date(2001, 1, 1)).days + 1), (2, 1)])
    # a range is few nodes, however many bins it covers
    nodes = spark.range(1).select(F.size(intervals._nodes(F.lit(700).cast("long"), F.lit(2100).cast("long"), 3)).alias("n")).first()[0]
    assert nodes <= 60


def test_no_nested_loop(spark):
    a = spark.range(100).selectExpr("id as la", "id + 5 as ha")
    b = spark.range(100).selectExpr("id as lb", "id + 9 as hb")
    plan = intervals.overlap_join(a, b, ("la", "ha"), ("lb", "hb"), bin_rows=5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        k = 1 if i % 3 == 0 else None if i % 50 == 1 else rng.randrange(30)
        v = None if i % 43 == 0 else 7.0 if i % 5 == 0 else round(rng.gauss(0, 100), 3)
        rows.append((k, v, i))
    return rows, spark.createDataFrame(rows, "k int, v double, id long").repartition(4)


SHARES = {"zero": 0.0, "p1": 0.01, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99, "top": 1.0}


def brute_percentiles(groups, cont):
    out = []
    for k, v in groups.items():
        v = sorted(x for x in v if x is not None)
        if not v:
            continue
        n, line = len(v), []
        for s in SHARES.values():
            if cont:
                at = (n - 1) * s
                line.append(v[math.floor(at)] * (1 - (at - math.floor(at))) + v[math.ceil(at)] * (at - math.floor(at)))
            else:
                line.append(v[max(1, n - math.floor(n - n * s)) - 1])
        out.append((k, n, *line))
    return out


@pytest.mark.parametrize("cont", [True, False])
@pytest.mark.parametrize("limit", [10**6, 300, 5])
def test_percentiles(skewed, cont, limit):
    rows, df = skewed
    groups = {}
    for k, v, _ in rows:
        groups.setdefault(k, []).append(v)
    got = exact_percentiles(df, ["k"], "v", SHARES, cont, rows=limit)
    assert got.columns == ["k", "n", *SHARES]
    want = brute_percentiles(groups, cont)
    assert same([[round(x, 9) if isinstance(x, float) else x for x in r] for r in got.collect()], [[round(x, 9) if isinstance(x, float) else x for x in r] for r in want])


def test_percentiles_of_other_types(spark):
    df = spark.range(20000).selectExpr("id % 2 as k", "cast(cast(id as decimal(20,0)) * 9007199254740993 % 9223372036854775807 as bigint) as big", "timestamp_micros(id * 77777777 % 1000003) as at",
                                       "cast(id % 3 as decimal(20,2)) as few", "if(id % 100 = 0, double('NaN'), double(id)) as f")
    for value in ("big", "at", "few", "f"):
        plain = exact_percentiles(df, ["k"], value, SHARES)
        hot_ = exact_percentiles(df, ["k"], value, SHARES, rows=50)
        assert plain.dtypes == hot_.dtypes and plain.schema["mid"].dataType == df.schema[value].dataType
        assert sorted(map(str, plain.collect())) == sorted(map(str, hot_.collect())), value
    whole = exact_percentiles(df, [], "big", SHARES, rows=100).collect()
    values = sorted(r[0] for r in df.select("big").collect())
    assert len(whole) == 1 and whole[0]["mid"] == values[9999] and whole[0]["top"] == values[-1] and whole[0]["zero"] == values[0]
    assert exact_percentiles(df.limit(0), ["k"], "big", SHARES).count() == 0
    assert exact_percentiles(df.limit(0), [], "big", SHARES).count() == 0


MEASURES = {"n": ("count", "*"), "vs": ("count", "v"), "total": ("sum", "v"), "mean": ("avg", "v"), "least": ("min", "v"), "most": ("max", "v"), "ids": ("distinct", "id"),
            "kinds": ("distinct", "v")}


def brute_sets(rows, columns, sets):
    """rows: dicts."""
    out = []
    for s in sets:
        groups = {} if s else {(): []}
        for r in rows:
            groups.setdefault(tuple(r[c] if c in s else None for c in columns) if s else (), []).append(r)
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        for key, own in groups.items():
            v = [r["v"] for r in own if r["v"] is not None]
            key = key if s else (None,) * len(columns)
            out.append((*key, bits, len(own), len(v), sum(v) if v else None, sum(v) / len(v) if v else None, min(v, default=None), max(v, default=None),
                        len({r["id"] for r in own if r["id"] is not None}), len(set(v))))
    return out


def test_grouping_sets(spark):
    rng = random.Random(10)
    rows = [dict(a=rng.choice(["x", "y", None]), b=rng.choice([1, 2, 3, None]), c=rng.randrange(3), v=rng.choice([None, 1, 2, 3, 4]), id=rng.choice([None, *range(20)])) for _ in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a string, b int, c int, v long, id int").repartition(3)
    columns = ["a", "b", "c"]
    for sets in ([("a", "b", "c"), ("a", "b"), ("a",), ()], grouping.cube_sets(columns), [("b",), ("c", "a"), ("b",)], [()]):
        got = grouping.grouping_sets(df, columns, sets, MEASURES)
        want = brute_sets(rows, columns, list(dict.fromkeys(tuple(c for c in columns if c in s) for s in sets)))
        assert same(got.collect(), want)
    assert grouping.rollup_sets(columns) == [("a", "b", "c"), ("a", "b"), ("a",), ()] and len(grouping.cube_sets(columns)) == 8
    none = df.limit(0)
    assert same(grouping.rollup(none, columns, MEASURES).collect(), [(None, None, None, 7, 0, 0, None, None, None, None, 0, 0)])
    assert same(grouping.grouping_sets(df, columns, [("a",), ()], {"ids": ("distinct", "id")}).collect(),
                [(*r[:4], r[-2]) for r in brute_sets(rows, columns, [("a",), ()])])
    with pytest.raises(ValueError):
        grouping.grouping_sets(df, columns, [("z",)], MEASURES)


def test_grouping_sets_read_the_rows_once(spark, monkeypatch):
    """Coarser sets come from staged states: the source is scanned by the finest grouping alone."""
    seen = []
    monkeypatch.setattr(grouping, "_staged", lambda df, name: (seen.append(name), hot._staged(df, name))[1])
    df = spark.range(1000).selectExpr("id % 5 as a", "id % 7 as b", "id % 11 as v")
    out = grouping.cube(df, ["a", "b"], {"n": ("count", "*"), "values": ("distinct", "v")})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and seen[0] == "finest-pairs"


@pytest.mark.parametrize("order,tie", [(["t"], ["id"]), (["-t"], ["-id"]), (["t", "-s"], ["id"]), (["s"], ["id"]), (["c"], ["id"])])
@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks_of_a_hot_key(spark, order, tie, keys):
    """c is one value for all rows, s one of three: their peers lie over many slices."""
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 1, if(id % 50 = 1, null, id % 20)) as k", "if(id % 10 = 0, null, id * 7919 % 300) as t", "concat('s', id % 3) as s", "0 as c").cache()
    how = dict(ntile={"four": 4, "many": 3000, "one": 1}, names={"r": "rank", "p": "percent_rank", "u": "cume_dist"})
    plain, cut = ranked(df, keys, order, tie, **how), ranked(df, keys, order, tie, rows=60, **how)
    assert plain.columns == cut.columns and plain.dtypes == cut.dtypes
    assert same(plain.collect(), cut.collect())
    w, peers = Window.partitionBy(*keys).orderBy(*hot.sort_columns([*order, *tie])), Window.partitionBy(*keys).orderBy(*hot.sort_columns(order))
    want = df.select("*", F.rank().over(peers).cast("long").alias("r"), F.percent_rank().over(peers).alias("p"), F.cume_dist().over(peers).alias("u"),
                     F.ntile(4).over(w).cast("long").alias("four"), F.ntile(3000).over(w).cast("long").alias("many"), F.ntile(1).over(w).cast("long").alias("one"))
    assert same(cut.collect(), want.collect())


def test_ranks_of_nothing(spark):
    df = spark.range(0).selectExpr("id", "id as k")
    assert ranked(df, ["k"], ["id"], ntile={"x": 3}).count() == 0
    with pytest.raises(ValueError):
        ranked(df, ["k"], ["id"], names={"x": "dense_rank"})


def test_sketches_stay_within_their_errors(spark, tmp_path):
    """Stored per day in two appends, united over all days; one group holds a third of the rows, one a single value."""
    df = spark.range(60000).selectExpr("date_add(date'2024-01-01', cast(id % 20 as int)) as day", "if(id % 3 = 0, 'big', concat('k', id % 7)) as k",
                                       "pmod(xxhash64(id), 20000) as user", "if(id % 7 = 3, 5D, if(id % 11 = 0, null, pow(pmod(xxhash64(id, 1), 1000), 2))) as v").cache()
    path = str(tmp_path / "sketches")
    for part in ("day < '2024-01-11'", "day >= '2024-01-11'"):
        sketches.append_sketches(sketches.sketch_table(df.where(part), F.col("day"), ["k"], {"users": "user"}, {"values": "v"}), path)
    stored = spark.read.parquet(path)
    assert stored.count() == df.select("day", "k").distinct().count()
    one = sketches.united(stored, ["k"], ["users"], ["values"])
    exact = {r["k"]: r for r in df.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user").alias("users"), F.sort_array(F.collect_list("v")).alias("v")).collect()}
    shares = [0.0, 0.01, 0.5, 0.9, 1.0]
    for r in one.select("k", "n", sketches.distinct_estimate("users").alias("d"), *[sketches.quantile_estimate("values", s).alias(f"q{i}") for i, s in enumerate(shares)]).collect():
        own = exact.pop(r["k"])
        assert r["n"] == own["n"] and abs(r["d"] - own["users"]) <= 3 * sketches.distinct_error() * own["users"] + 1
        for i, s in enumerate(shares):
            below, upto = (sum(op(x) for x in own["v"]) / len(own["v"]) for op in (lambda x, q=r[f"q{i}"]: x < q, lambda x, q=r[f"q{i}"]: x <= q))
            assert below - 2 * sketches.rank_error() <= s <= upto + 2 * sketches.rank_error()
    assert not exact
    none = sketches.sketch_table(df.limit(0), F.col("day"), ["k"], {"users": "user"}, {"values": "v"})
    assert sketches.united(none, ["k"], ["users"], ["values"]).count() == 0
    nulls = sketches.united(sketches.sketch_table(spark.range(3).selectExpr("null as day", "cast(null as long) as u", "cast(null as double) as v"), F.col("day"), [], {"u": "u"}, {"v": "v"}), [], ["u"], ["v"])
    assert [tuple(r) for r in nulls.select("n", sketches.distinct_estimate("u"), sketches.quantile_estimate("v", 0.5)).collect()] == [(3, 0, None)]
