"""Window operators."""

from decimal import Decimal

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.operators import windows as w
from loomwork.operators.hot import numbered, running_sum

USER = ["user_id"]
TIME = ["ts", "event_id"]


def user_events(t):
    return t.events.select("user_id", "ts", "event_id", "event_type", "value")


def exact_events(t):
    """Values as decimals: their sums are exact in any order, whatever the way of summing."""
    return user_events(t).withColumn("value", F.col("value").cast("decimal(18,6)"))


@query("keep_first", """
    select l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem
    qualify row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber, l_quantity) = 1""")
def keep_first(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return w.keep_first(rows, ["l_suppkey"], ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])


@query("dense_rank_keys", """
    select l_orderkey, l_linenumber, l_partkey, dense_rank() over (order by l_returnflag, l_linestatus, l_suppkey) as dense_value
    from lineitem""")
def dense_rank_keys(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_suppkey")
    return (w.dense_rank_of(rows, ["l_returnflag", "l_linestatus", "l_suppkey"])
            .select("l_orderkey", "l_linenumber", "l_partkey", "dense_value"))


@query("running_total", """
    select user_id, event_id, round(sum(value) over (partition by user_id order by ts, event_id), 4) as total from events""")
def running_total(t):
    return (running_sum(exact_events(t), USER, TIME, "value", "total")
            .select("user_id", "event_id", F.round(F.col("total").cast("double"), 4).alias("total")))


@query("sliding_items", """
    select user_id, event_id, p2 || '>' || p1 || '>' || event_type as window from
    (select *, lag(event_type, 2) over w as p2, lag(event_type) over w as p1 from events
     window w as (partition by user_id order by ts, event_id)) where p2 is not null""")
def sliding_items(t):
    return (w.sliding(user_events(t), USER, TIME, "event_type", 3)
            .select("user_id", "event_id", F.array_join("window", ">").alias("window")))


@query("take_until_sum", """
    select user_id, event_id, value from (select *, sum(value) over (partition by user_id order by ts, event_id) - value as before
    from events) where before <= 150.005""")
def take_until_sum(t):
    return w.take_until(exact_events(t), USER, TIME, "value", Decimal("150.005")).select("user_id", "event_id", F.col("value").cast("double").alias("value"))


@query("last_n", """
    select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3""")
def last_n(t):
    return w.last_n(user_events(t), USER, TIME, 3).select("user_id", "event_id", "event_type")


@query("find_first_last", """
    with n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)
    select user_id, arg_min(value, i) filter (where event_type = 'error') as first_value,
           coalesce(min(i) filter (where event_type = 'error'), -1) as first_index,
           arg_max(value, i) filter (where event_type = 'error') as last_value,
           coalesce(max(i) filter (where event_type = 'error'), -1) as last_index from n group by user_id""")
def find_first_last(t):
    return w.first_and_last(user_events(t), USER, TIME, F.col("event_type") == "error", "value")


@query("chunking", """
    with n as (select *, (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1) // 4 as part_no from orders)
    select o_custkey, part_no, string_agg(o_orderkey, ',' order by o_orderdate, o_orderkey) as items from n group by o_custkey, part_no""")
def chunking(t):
    got = w.chunks(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                   F.col("o_orderkey").cast("string"), 4)
    return got.withColumn("items", F.array_join("items", ","))


@query("enumerate_rows", """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over
        (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem""")
def enumerate_rows(t):
    return numbered(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ["l_orderkey"],
                    ["l_linenumber", "l_partkey", "l_suppkey"], "rn")


@query("at_negative", """
    select user_id, max(event_type) filter (where r = 1) as at_1, max(event_type) filter (where r = 2) as at_2,
           max(event_type) filter (where r = 99) as at_99 from
    (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) group by user_id""")
def at_negative(t):
    return w.from_end(user_events(t), USER, TIME, "event_type", [-1, -2, -99])
