"""Joins and lookups."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import numbered_sql, query
from loomwork.operators import joins as j
from loomwork.operators.hot import collect_ordered


@query("left_chain", """
    select a.l_orderkey, a.n, b.o_custkey, c.c_name from
    (select l_orderkey, count(*) as n from lineitem where l_returnflag <> 'R' group by l_orderkey) a
    left join (select o_orderkey, o_custkey from orders where o_orderstatus = 'O') b on a.l_orderkey = b.o_orderkey
    left join customer c on b.o_custkey = c.c_custkey""")
def left_chain(t):
    a = t.lineitem.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    b = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    return (a.join(b, a.l_orderkey == b.o_orderkey, "left").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("l_orderkey", "n", "o_custkey", "c_name"))


@query("presence_flag", """
    select o_orderkey, case when c_custkey is not null then 'Y' else 'N' end as known
    from orders left join (select distinct c_custkey from customer where c_mktsegment = 'BUILDING') on o_custkey = c_custkey""")
def presence_flag(t):
    return j.flag_present(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_mktsegment = 'BUILDING'"),
                          "o_custkey", "c_custkey", "known").drop("o_custkey")


@query("double_role", """
    select o_orderkey, c.c_name as buyer, d.c_name as twin from orders
    left join customer c on o_custkey = c.c_custkey left join customer d on o_orderkey = d.c_custkey""")
def double_role(t):
    c, d = t.customer.alias("c"), t.customer.alias("d")
    return (t.orders.join(c, F.col("o_custkey") == F.col("c.c_custkey"), "left")
            .join(d, F.col("o_orderkey") == F.col("d.c_custkey"), "left")
            .select("o_orderkey", F.col("c.c_name").alias("buyer"), F.col("d.c_name").alias("twin")))


@query("inner_join", """
    select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2""")
def inner_join(t):
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey = 2")
            .select("c_custkey", "n_name"))


@query("linked_pairs", """
    with p as (select o_orderkey, o_custkey, o_orderpriority, o_orderstatus from orders)
    select a.o_orderkey, min(b.o_orderkey) as linked, count(b.o_orderkey) as n_linked
    from p a left join p b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority
        and a.o_orderkey <> b.o_orderkey and b.o_orderstatus <> 'F' group by a.o_orderkey""")
def linked_pairs(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return (j.linked_record(rows, "o_orderkey", ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") != "F")
            .select("o_orderkey", "linked", "n_linked"))


PARAMS = """
    params as (select cast(o_orderkey as varchar) as order_number, unnest(['BundleId', 'Arrivalslot', 'RingAhead']) as name,
        unnest([cast(o_custkey as varchar), case when o_orderstatus = 'F' then o_orderpriority else '' end,
                case when o_totalprice > 300000 then strftime(o_orderdate, '%Y-%m-%d') else '' end]) as value from orders)"""


def order_params(t):
    """Orders as attribute rows ``(order_number, name, value)``."""
    return t.orders.select(F.col("o_orderkey").cast("string").alias("order_number"), F.expr("""
        stack(3, 'BundleId', cast(o_custkey as string),
                 'Arrivalslot', case when o_orderstatus = 'F' then o_orderpriority else '' end,
                 'RingAhead', case when o_totalprice > 300000 then date_format(o_orderdate, 'yyyy-MM-dd') else '' end)
        as (name, value)"""))


@query("bundle_lookup", "with" + PARAMS + """
    select b.value as bundle, min(case when f.name = 'Arrivalslot' then f.value end) as Arrivalslot,
           min(case when f.name = 'RingAhead' then f.value end) as RingAhead
    from params b join params f on b.order_number = f.order_number
    where b.name = 'BundleId' and f.name in ('Arrivalslot', 'RingAhead') and f.value <> '' group by b.value""")
def bundle_lookup(t):
    return j.bundle_values(order_params(t), "order_number", "name", "value", "BundleId", ["Arrivalslot", "RingAhead"])


@query("exists_semi", """
    select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def exists_semi(t):
    hits = t.orders.where("o_orderstatus = 'P'")
    return t.customer.join(hits, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("not_exists_anti", """
    select c_custkey, c_name from customer c where not exists
        (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'O')""")
def not_exists_anti(t):
    hits = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    return t.customer.join(hits, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


BANDS = [("O", 0, 99999, "open small"), ("O", 100000, 299999, "open medium"), ("O", 300000, 999999, "open large"),
         ("P", 0, 199999, "part small"), ("P", 150000, 999999, "part large")]


@query("range_lookup", f"""
    select o_orderkey, note from orders join (values {', '.join(map(str, BANDS))}) r(status, low, high, note)
    on status = o_orderstatus and cast(floor(o_totalprice) as bigint) between low and high""")
def range_lookup(t):
    rules = F.broadcast(t.spark.createDataFrame(BANDS, "status string, low bigint, high bigint, note string"))
    return j.range_lookup(t.orders, rules, F.col("status") == F.col("o_orderstatus"), F.floor("o_totalprice"),
                          "low", "high").select("o_orderkey", "note")


@query("lookup_chain", """
    select l_orderkey, l_linenumber, l_partkey, c_name, n_name, r_name from lineitem
    left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
    left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def lookup_chain(t):
    who = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
           .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "c_name", "n_name", "r_name"))
    return (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
            .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
            .join(who, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("l_orderkey", "l_linenumber", "l_partkey", "c_name", "n_name", "r_name"))


@query("fallback_lookup", """
    select o_orderkey, coalesce(nullif(rtrim(case when o_orderstatus = 'O' then o_orderpriority when o_orderstatus = 'P'
        then '  ' end), ''), c_mktsegment) as value from orders left join customer on o_custkey = c_custkey""")
def fallback_lookup(t):
    first = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "P", "  ")
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("o_orderkey", j.with_fallback(first, F.col("c_mktsegment")).alias("value")))


@query("scalar_subquery", """
    select l_orderkey, l_linenumber, l_partkey from lineitem
    where l_extendedprice > (select avg(l_extendedprice) * 1.9 from lineitem)""")
def scalar_subquery(t):
    top = t.lineitem.agg((F.avg("l_extendedprice") * 1.9).alias("x"))
    return t.lineitem.where(F.col("l_extendedprice") > top.scalar()).select("l_orderkey", "l_linenumber", "l_partkey")


PEERS = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate"


@query("peer_concat", f"select l_orderkey, l_returnflag, part_no, string_agg(l_linestatus || l_linenumber, ';' order by {PEERS}) as peers from "
       + numbered_sql("lineitem", "l_orderkey, l_returnflag", PEERS) + " group by l_orderkey, l_returnflag, part_no")
def peer_concat(t):
    text = F.concat("l_linestatus", F.col("l_linenumber").cast("string"))
    lists = collect_ordered(t.lineitem, ["l_orderkey", "l_returnflag"],
                            ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"], text)
    return lists.select("l_orderkey", "l_returnflag", "part_no", F.array_join("items", ";").alias("peers"))


@query("keep_prior", """
    select o_orderkey, case when c_custkey is not null then c_mktsegment else 'prior' end as by_select, c_mktsegment as by_set
    from orders left join (select * from customer where c_acctbal > 5000) on o_custkey = c_custkey""")
def keep_prior(t):
    both = t.orders.join(t.customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.select("o_orderkey", j.keep_prior(F.col("c_mktsegment"), F.col("c_custkey").isNotNull(), F.lit("prior"))
                       .alias("by_select"), F.col("c_mktsegment").alias("by_set"))
