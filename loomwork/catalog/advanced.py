"""As-of and interval joins, exact percentiles, grouping sets, ranks."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.operators import grouping, intervals, sketches
from loomwork.operators.asof import asof_join
from loomwork.operators.percentiles import exact_percentiles
from loomwork.operators.ranks import ranked
from loomwork.session import fresh_path
from loomwork.sources.tables import staged


def events_of(t, kind, *columns):
    return t.events.where(F.col("event_type") == kind).select(*columns)


@query("asof_backward", """
    select l.event_id, l.user_id, case when l.ts - r.ts <= interval 12 hour then r.event_id end as seen, case when l.ts - r.ts <= interval 12 hour then r.value end as seen_value
    from (select * from events where event_type = 'purchase') l
    asof left join (select * from events where event_type = 'view') r on l.user_id = r.user_id and l.ts >= r.ts""")
def asof_backward(t):
    return asof_join(events_of(t, "purchase", "event_id", "user_id", "ts"), events_of(t, "view", "event_id", "user_id", "ts", "value"), ["user_id"], "ts", "ts",
                     {"seen": "event_id", "seen_value": "value"}, tolerance=F.expr("interval 12 hours"), tie=["event_id"]).drop("ts")


@query("asof_forward", """
    select l.event_id, l.user_id, r.event_id as next_error from (select * from events where event_type = 'click') l
    asof left join (select * from events where event_type = 'error') r on l.user_id = r.user_id and l.ts < r.ts""")
def asof_forward(t):
    return asof_join(events_of(t, "click", "event_id", "user_id", "ts"), events_of(t, "error", "event_id", "user_id", "ts"), ["user_id"], "ts", "ts",
                     {"next_error": "event_id"}, direction="forward", exact=False, tie=["event_id"]).drop("ts")


@query("asof_nearest", """
    with l as (select * from events where event_type = 'signup'), r as (select * from events where event_type = 'click'),
    b as (select l.event_id, r.event_id as id, l.ts - r.ts as far from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts),
    f as (select l.event_id, r.event_id as id, r.ts - l.ts as far from l asof left join r on l.user_id = r.user_id and l.ts <= r.ts)
    select event_id, case when b.id is null or f.far < b.far then f.id else b.id end as closest from b join f using (event_id)""")
def asof_nearest(t):
    return asof_join(events_of(t, "signup", "event_id", "user_id", "ts"), events_of(t, "click", "event_id", "user_id", "ts"), ["user_id"], "ts", "ts",
                     {"closest": "event_id"}, direction="nearest", tie=["event_id"]).select("event_id", "closest")


@query("overlap_windows", """
    with p as (select event_id, ts - interval 10 minute as a, ts + interval 10 minute as b from events where event_type = 'purchase'),
    e as (select event_id, ts - interval 30 minute as a, ts + to_minutes(cast(floor(value) as bigint)) as b from events where event_type = 'error')
    select p.event_id as purchase, e.event_id as error from p join e on p.a <= e.b and e.a <= p.b""")
def overlap_windows(t):
    p = t.events.where("event_type = 'purchase'").selectExpr("event_id as purchase", "ts - interval 10 minutes as p_start", "ts + interval 10 minutes as p_end")
    e = t.events.where("event_type = 'error'").selectExpr("event_id as error", "ts - interval 30 minutes as e_start", "ts + make_dt_interval(0, 0, cast(floor(value) as int)) as e_end")
    return intervals.overlap_join(p, e, ("p_start", "p_end"), ("e_start", "e_end")).select("purchase", "error")


OPEN_SQL = "select o_custkey, o_orderkey, o_orderdate as a, max(l_shipdate) as b from orders join lineitem on o_orderkey = l_orderkey group by all"


@query("overlap_open_orders", f"""
    with s as ({OPEN_SQL}) select x.o_custkey as custkey, x.o_orderkey as first_order, y.o_orderkey as other_order
    from s x join s y on x.o_custkey = y.o_custkey and x.o_orderkey < y.o_orderkey and x.a < y.b and y.a < x.b and x.a < x.b and y.a < y.b""")
def overlap_open_orders(t):
    """Orders of a customer that were open at the same time: from the order date to the last shipment, ends left out."""
    span = (t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey", "o_orderdate")
            .agg(F.max("l_shipdate").alias("shipped")))
    span = staged(span, "order_spans")  # read several times
    x, y = (span.select(F.col("o_custkey").alias(f"c{s}"), F.col("o_orderkey").alias(f"o{s}"), F.col("o_orderdate").alias(f"a{s}"), F.col("shipped").alias(f"b{s}")) for s in "xy")
    pairs = intervals.overlap_join(x, y, ("ax", "bx"), ("ay", "by"), [("cx", "cy")], closed=False)
    return pairs.where("ox < oy").select(F.col("cx").alias("custkey"), F.col("ox").alias("first_order"), F.col("oy").alias("other_order"))


@query("range_points", """
    with bands as (select p_partkey, p_retailprice * 20 as low, p_retailprice * 20 + case when p_partkey % 3 = 0 then 20 else 0.5 end * p_size as high from part)
    select p_partkey, count(*) as orders, min(o_totalprice) as least, max(o_totalprice) as most
    from orders join bands on o_totalprice between low and high group by p_partkey""")
def range_points(t):
    """How many order totals lie in a band of prices; every third band is forty times as wide."""
    bands = t.part.selectExpr("p_partkey", "p_retailprice * 20 as low", "p_retailprice * 20 + if(p_partkey % 3 = 0, 20D, 0.5D) * p_size as high")
    found = intervals.range_join(t.orders.select("o_totalprice"), bands, "o_totalprice", "low", "high", totals=("orders", "least", "most"))
    return found.groupBy("p_partkey").agg(F.sum("orders").alias("orders"), F.min("least").alias("least"), F.max("most").alias("most"))


@query("percentile_disc", """
    select event_type, count(*) as n, quantile_disc(value, 0.25) as q1, quantile_disc(value, 0.5) as mid, quantile_disc(value, 0.95) as p95, quantile_disc(value, 1) as top
    from events group by event_type""")
def percentile_disc(t):
    return exact_percentiles(t.events, ["event_type"], "value", {"q1": 0.25, "mid": 0.5, "p95": 0.95, "top": 1.0})


@query("percentile_cont", """
    select l_returnflag, l_linestatus, count(*) as n, quantile_cont(l_extendedprice, 0.1) as p10, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.99) as p99
    from lineitem group by all""")
def percentile_cont(t):
    return exact_percentiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, cont=True)


@query("percentile_whole", "select count(*) as n, quantile_disc(o_orderdate, 0.5) as mid_date, quantile_disc(o_orderdate, 0.999) as late_date from orders")
def percentile_whole(t):
    return exact_percentiles(t.orders, [], "o_orderdate", {"mid_date": 0.5, "late_date": 0.999})


LINES = ["l_returnflag", "l_linestatus", "ship_year"]
MEASURES = {"n": ("count", "*"), "quantity": ("sum", "l_quantity"), "discount": ("avg", "l_discount"), "first_ship": ("min", "l_shipdate"),
            "dearest": ("max", "l_extendedprice"), "suppliers": ("distinct", "l_suppkey")}
LINES_SQL = """select l_returnflag, l_linestatus, ship_year, grouping_id(l_returnflag, l_linestatus, ship_year) as grouping_id, count(*) as n, sum(l_quantity) as quantity,
    round(avg(l_discount), 9) as discount, min(l_shipdate) as first_ship, max(l_extendedprice) as dearest, count(distinct l_suppkey) as suppliers
    from (select *, year(l_shipdate) as ship_year from lineitem) group by """


def _lines(t):
    return t.lineitem.withColumn("ship_year", F.year("l_shipdate").cast("long"))


def _rounded(df):
    return df.withColumn("discount", F.round("discount", 9))


@query("rollup", LINES_SQL + "rollup (l_returnflag, l_linestatus, ship_year)")
def rollup(t):
    return _rounded(grouping.rollup(_lines(t), LINES, MEASURES))


@query("cube", LINES_SQL + "cube (l_returnflag, l_linestatus, ship_year)")
def cube(t):
    return _rounded(grouping.cube(_lines(t), LINES, MEASURES))


@query("grouping_sets", LINES_SQL + "grouping sets ((l_returnflag, ship_year), (l_linestatus), (ship_year), ())")
def grouping_sets(t):
    sets = [("l_returnflag", "ship_year"), ("l_linestatus",), ("ship_year",), ()]
    return _rounded(grouping.grouping_sets(_lines(t), LINES, sets, MEASURES))


@query("rank_shares", """
    select event_id, rank() over w as place, round(percent_rank() over w, 9) as share_below, round(cume_dist() over w, 9) as share_upto
    from events window w as (partition by event_type order by round(value))""")
def rank_shares(t):
    rows = t.events.select("event_id", "event_type", F.round("value").alias("points"))
    out = ranked(rows, ["event_type"], ["points"], ["event_id"], names={"place": "rank", "share_below": "percent_rank", "share_upto": "cume_dist"})
    return out.select("event_id", "place", F.round("share_below", 9).alias("share_below"), F.round("share_upto", 9).alias("share_upto"))


@query("ntile_groups", """
    select event_id, ntile(7) over (partition by event_type order by value desc, event_id desc) as seventh, ntile(1000) over (order by value desc, event_id desc) as tile from events""")
def ntile_groups(t):
    rows = t.events.select("event_id", "event_type", "value")
    sevenths = ranked(rows, ["event_type"], ["-value"], ["-event_id"], ntile={"seventh": 7})
    return ranked(sevenths, [], ["-value"], ["-event_id"], ntile={"tile": 1000}).select("event_id", "seventh", "tile")


def _stored_sketches(t):
    """Sketches of two runs of days, stored by day and read back."""
    path = fresh_path(t.spark, "sketches")
    for late in (False, True):
        part = t.events.where((F.dayofmonth("ts") > 15) == F.lit(late))
        sketches.append_sketches(sketches.sketch_table(part, F.to_date("ts"), ["event_type"], {"users": "event_id"}, {"values": "value"}), path)
    return sketches.united(t.spark.read.parquet(path), ["event_type"], ["users"], ["values"])


@query("sketch_distinct", "select event_type, count(*) as n, count(distinct event_id) as ids, true as within from events group by event_type")
def sketch_distinct(t):
    """Distinct ids per type, exact, and whether the estimate from the stored sketches lies within its stated error."""
    exact = t.events.groupBy("event_type").agg(F.countDistinct("event_id").alias("ids"))
    near = F.abs(sketches.distinct_estimate("users") - F.col("ids")) <= 3 * sketches.distinct_error() * F.col("ids") + 1
    return _stored_sketches(t).join(exact, "event_type").select("event_type", "n", "ids", near.alias("within"))


@query("sketch_quantiles", "select event_type, share, true as within from (select distinct event_type from events), (values (0.1::double), (0.5::double), (0.99::double)) as s(share)")
def sketch_quantiles(t):
    """Whether the share of the rows up to each estimated quantile lies within the stated error of what was asked for."""
    found = _stored_sketches(t).select("event_type", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), sketches.quantile_estimate("values", s).alias("at")) for s in (0.1, 0.5, 0.99)])).alias("q"))
    found = found.select("event_type", "n", "q.share", "q.at")
    ranks = t.events.join(found, "event_type").groupBy("event_type", "share").agg(
        F.avg((F.col("value") < F.col("at")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("at")).cast("int")).alias("upto"), F.max("n").alias("n"))
    slack = 2 * sketches.rank_error() + 1 / F.col("n")
    return ranks.select("event_type", "share", ((F.col("below") - slack <= F.col("share")) & (F.col("upto") + slack >= F.col("share"))).alias("within"))
