"""Graph and hierarchy operators."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.functions.structured import json_leaves
from loomwork.operators import graph as g
from loomwork.operators.hot import numbered

c = F.col


def link(df, src, dst):
    return df.select(src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"))


@query("bfs_reach", """
    with e as (select r_regionkey::bigint as src, 100 + n_nationkey::bigint as dst from nation join region on n_regionkey = r_regionkey
        union all select 100 + n_nationkey, n_regionkey from nation union all select 100 + c_nationkey, 1000 + c_custkey from customer
        union all select 1000 + c_custkey, 100 + c_nationkey from customer),
    t as (select n.dst as node, n.src as parent, 1 as depth from e n where n.src = 2 and n.dst >= 100
        union all select c.dst, c.src, 2 from e c join e n on n.dst = c.src where n.src = 2 and n.dst >= 100 and c.dst >= 1000)
    select 2::bigint as node, null::bigint as parent, 0 as depth, 0::bigint as position
    union all select node, parent, depth, row_number() over (order by depth, parent, node) from t""")
def bfs_reach(t):
    nation = c("n_nationkey") + 100
    edges = (link(t.nation, c("n_regionkey"), nation).union(link(t.nation, nation, c("n_regionkey")))
             .union(link(t.customer, c("c_nationkey") + 100, c("c_custkey") + 1000))
             .union(link(t.customer, c("c_custkey") + 1000, c("c_nationkey") + 100)))
    start = t.region.where("r_name = 'ASIA'").select(c("r_regionkey").cast("bigint").alias("node"))
    return g.breadth_first(edges, start)


@query("tree_walk", """
    with p as (select r_regionkey::bigint as node, null::bigint as parent, 0 as depth, r_name as path from region
        union all select 100 + n_nationkey, n_regionkey, 1, r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey
        union all select 1000 + c_custkey, 100 + c_nationkey, 2, r_name || '/' || n_name || '/' || c_name from customer
            join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select *, row_number() over (order by path) as position from p""")
def tree_walk(t):
    edges = (t.nation.select(c("n_regionkey").cast("bigint").alias("src"), (c("n_nationkey") + 100).cast("bigint").alias("dst"), c("n_name").alias("label"))
             .union(t.customer.select((c("c_nationkey") + 100).cast("bigint"), (c("c_custkey") + 1000).cast("bigint"), c("c_name"))))
    roots = t.region.select(c("r_regionkey").cast("bigint").alias("node"), c("r_name").alias("label"))
    return numbered(g.walk_tree(edges, roots), [], ["path"], "position")


@query("cause_chain", """
    with recursive w as (select event_id as node, event_id as root, 0 as depth from events
        union all select node, (root - 1) // 3, depth + 1 from w where root > 4)
    select node, min(root) as root, max(depth) as depth from w group by node""")
def cause_chain(t):
    # every event was caused by an earlier one, except the first five, which are roots
    links = t.events.select(c("event_id").alias("node"), F.when(c("event_id") > 4, F.expr("(event_id - 1) div 3")).alias("parent"))
    return g.chain_ends(links)


@query("flatten_depth", """
    select o_orderkey, o_orderkey || ',' || o_custkey || ',"' || o_orderpriority || '",' || (o_orderkey + 1) || ',-7' as flat from orders""")
def flatten_depth(t):
    nested = F.concat(F.lit("["), c("o_orderkey").cast("string"), F.lit(", [["), c("o_custkey").cast("string"), F.lit(', ["'), c("o_orderpriority"),
                      F.lit('"]], [], [[['), (c("o_orderkey") + 1).cast("string"), F.lit("]], -7]]]"))
    return t.orders.select("o_orderkey", F.array_join(json_leaves(nested), ",").alias("flat"))
