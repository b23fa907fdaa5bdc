"""Sorting, limits, top-k and set operations."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.operators import aggregates as a
from loomwork.operators import ordering as o


@query("sort_multi", """
    select o_orderkey, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) as position from orders""")
def sort_multi(t):
    return (o.sorted_positions(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"),
                               ["o_orderpriority", "-o_totalprice", "o_orderkey"]).select("o_orderkey", "position"))


@query("text_vs_numeric_sort", """
    select p_partkey, row_number() over (order by cast(p_size as varchar), p_partkey) as as_text,
           row_number() over (order by p_size, p_partkey) as as_number from part""")
def text_vs_numeric_sort(t):
    rows = t.part.select("p_partkey", "p_size", F.col("p_size").cast("string").alias("size_text"))
    rows = o.sorted_positions(rows, ["size_text", "p_partkey"], "as_text")
    return o.sorted_positions(rows, ["p_size", "p_partkey"], "as_number").select("p_partkey", "as_text", "as_number")


@query("stable_sort", """
    select c_custkey, c_mktsegment, row_number() over (order by c_mktsegment, c_custkey) as position from customer""")
def stable_sort(t):
    # the input order is the customer key; as last key it keeps ties in input order
    return o.sorted_positions(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"])


@query("limit_n", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25")
def limit_n(t):
    return o.take(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 25)


@query("top_k_words", r"""
    select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '\s+')) as word from documents)
    where word <> '' group by word order by n desc, word limit 20""")
def top_k_words(t):
    return o.take(a.frequencies(a.words(t.documents, "text"), "word"), ["-n", "word"], 20)


@query("first_any", "select o_custkey, min(o_orderpriority) as priority from orders where o_orderpriority <> '' group by o_custkey")
def first_any(t):
    return o.any_one(t.orders.where("o_orderpriority <> ''"), ["o_custkey"], "o_orderpriority", "priority")


@query("reverse_rows", "select event_id, row_number() over (order by ts desc, event_id desc) as position from events")
def reverse_rows(t):
    return o.sorted_positions(t.events.select("event_id", "ts"), ["-ts", "-event_id"]).select("event_id", "position")


@query("shuffle_rows", "select n_nationkey, n_name from nation")
def shuffle_rows(t):
    return o.shuffled(t.nation.select("n_nationkey", "n_name"), 7)


@query("set_ops", """
    select 'union' as op, k from (select c_nationkey as k from customer where c_acctbal > 9900 union select s_nationkey from supplier where s_acctbal > 9000)
    union all select 'intersect', k from (select c_nationkey as k from customer where c_acctbal > 9900 intersect select s_nationkey from supplier where s_acctbal > 9000)
    union all select 'except', k from (select c_nationkey as k from customer where c_acctbal > 9900 except select s_nationkey from supplier where s_acctbal > 9000)""")
def set_ops(t):
    x = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    y = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))

    def named(op, df):
        return df.select(F.lit(op).alias("op"), "k")
    return (named("union", x.union(y).distinct()).unionByName(named("intersect", x.intersect(y)))
            .unionByName(named("except", x.subtract(y))))


@query("union_all", """
    select c_custkey as id, c_name as name, c_nationkey as nation from customer
    union all select s_suppkey, s_name, s_nationkey from supplier""")
def union_all(t):
    x = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    y = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return x.unionByName(y)


@query("layered_config", """
    with l as (select cast(c_custkey as varchar) as key, c_mktsegment as value, 0 as layer from customer
        union all select cast(o_custkey as varchar), max(o_orderpriority), 1 from orders where o_orderstatus = 'O' and o_totalprice > 400000 group by 1
        union all select cast(s_suppkey as varchar), s_name, 2 from supplier)
    select key, arg_max(value, layer) as value from l group by key""")
def layered_config(t):
    base = t.customer.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    middle = (t.orders.where("o_orderstatus = 'O' and o_totalprice > 400000").groupBy(F.col("o_custkey").cast("string").alias("key"))
              .agg(F.max("o_orderpriority").alias("value")))
    top = t.supplier.select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value"))
    return o.layered([base, middle, top], "key", "value")
