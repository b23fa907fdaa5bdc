"""Table changes."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.operators import changes as ch
from loomwork.session import fresh_path
from loomwork.sources import versions


@query("upsert", """
    with c as (select l_orderkey, l_linestatus from lineitem where l_returnflag = 'R'
        qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc) = 1),
    b as (select o_orderkey, o_orderpriority from orders where o_orderstatus <> 'P')
    select coalesce(o_orderkey, l_orderkey) as order_number, coalesce(l_linestatus, o_orderpriority) as value
    from b full join c on o_orderkey = l_orderkey""")
def upsert(t):
    base = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("order_number"), F.col("o_orderpriority").alias("value"))
    new = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_number"), F.col("l_linestatus").alias("value"),
                                                        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return ch.upsert(base, new, ["order_number"], "value", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])


@query("insert_missing", """
    select c_custkey, c_name from customer where c_nationkey < 20
    union all select c_custkey, lower(c_name) from customer where c_nationkey >= 20""")
def insert_missing(t):
    base = t.customer.where("c_nationkey < 20").select("c_custkey", "c_name")
    return ch.insert_missing(base, t.customer.select("c_custkey", F.lower("c_name").alias("c_name")), ["c_custkey"])


@query("update_where", """
    select o_orderkey, case when o_orderstatus = 'O' and o_totalprice > 200000 then 'W' else o_orderstatus end as o_orderstatus,
           case when o_orderstatus = 'O' and o_totalprice > 200000 then timestamp '2024-05-23 08:00:00' else o_orderdate end as o_orderdate
    from orders""")
def update_where(t):
    return ch.update_where(t.orders, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), o_orderstatus=F.lit("W"),
                           o_orderdate=F.lit("2024-05-23 08:00:00").cast("timestamp_ntz")
                           ).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("update_all_of_owner", """
    select l_orderkey, l_linenumber, l_partkey,
           case when l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') then 'Y' else l_returnflag end as l_returnflag
    from lineitem""")
def update_all_of_owner(t):
    owners = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("hit"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").join(owners, "l_orderkey", "left")
    return ch.update_where(rows, F.col("hit"), l_returnflag=F.lit("Y")).drop("hit")


@query("delete_where", """
    select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where not (l_returnflag = 'A' and l_quantity > 20)
    and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')""")
def delete_where(t):
    rows = ch.delete_where(t.lineitem, (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 20))
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ch.delete_keys(rows, gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("insert_select", """
    select o_orderkey as id, 'order' as kind, o_orderstatus as code from orders where o_totalprice > 250000
    union all select c_custkey, 'customer', c_mktsegment from customer where c_acctbal < 0""")
def insert_select(t):
    work = t.orders.where("o_totalprice > 250000").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("code"))
    more = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("code"))
    return work.unionByName(more)


@query("apply_accepted", """
    with r as (select *, case when o_totalprice > 400000 then '9739' when o_orderpriority = '5-LOW' and o_orderstatus = 'F' then '113' end as code from orders),
    a as (select o_custkey, count(*) filter (where code is null) as accepted, count(*) filter (where code is not null) as rejected,
          sum(case when code is null then cast(o_totalprice as decimal(18,2)) end) as spent from r group by o_custkey)
    select c_custkey, coalesce(accepted, 0) as accepted, coalesce(rejected, 0) as rejected,
           round(c_acctbal - coalesce(spent, 0)::double, 2) as balance from customer left join a on c_custkey = o_custkey""")
def apply_accepted(t):
    code = F.when(F.col("o_totalprice") > 400000, "9739").when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"), "113")
    judged = t.orders.withColumn("code", code)
    # the whole change set comes from accepted requests only; rejected ones leave no trace in the table
    sums = judged.groupBy("o_custkey").agg(
        F.count_if(F.col("code").isNull()).alias("accepted"), F.count_if(F.col("code").isNotNull()).alias("rejected"),
        F.sum(F.when(F.col("code").isNull(), F.col("o_totalprice").cast("decimal(18,2)"))).alias("spent"))
    out = t.customer.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected"),
                      F.round(F.col("c_acctbal") - F.coalesce(F.col("spent").cast("double"), F.lit(0.0)), 2).alias("balance"))


@query("sequence_alloc", """
    select o_orderkey, (select max(c_custkey) from customer) + row_number() over (order by o_orderdate, o_orderkey) as seq,
           (select max(c_custkey) from customer) + (select count(*) from orders) as counter_after from orders""")
def sequence_alloc(t):
    counter = t.customer.agg(F.max("c_custkey").alias("value"))
    rows, after = ch.allocate(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], counter, "seq")
    return rows.select("o_orderkey", "seq", after.scalar().alias("counter_after"))


@query("serial_odometer", """
    with n as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 + 996 as pos from orders),
    s as (select *, pos // 999 + 25 * 26 + 24 as step from n)
    select o_orderkey, case when step // 676 = 0 then 'ALCLF112' else 'ALCLF1' || (12 + step // 676) end
        || chr(cast(65 + step % 676 // 26 as int)) || chr(cast(65 + step % 26 as int))
        || lpad(cast(pos % 999 + 1 as varchar), 3, '0') as serial from s""")
def serial_odometer(t):
    from loomwork.operators.hot import numbered
    rows = numbered(t.orders.select("o_orderkey", "o_orderdate"), [], ["o_orderdate", "o_orderkey"], "rn")
    return rows.select("o_orderkey", ch.odometer(F.col("rn") - 1, "ALCLF112", "ZY", 997).alias("serial"))


COMMANDS = {"signup": "create", "purchase": "update", "error": "delete", "click": "reset"}


@query("command_feed", """
    with c as (select user_id as k, ts, event_id, case event_type when 'signup' then 'create' when 'purchase' then 'update' when 'error' then 'delete'
               else 'reset' end as act, event_type || event_id as v from events where event_type <> 'view'),
    life as (select k, arg_max(act, (ts, event_id)) as act, max((ts, event_id)) as since from c where act in ('create', 'delete') group by k),
    rest as (select c.*, life.act as life from c left join life on c.k = life.k where since is null or (c.ts, c.event_id) >= since),
    e as (select k, max(life) as life, arg_max(v, (ts, event_id)) filter (where act in ('create', 'update')) as v, bool_or(act = 'reset') as r from rest group by k)
    select coalesce(c_custkey, k) as id, coalesce(v, c_name) as email, coalesce(r, false) as reset
    from customer full join e on c_custkey = k where case when life is not null then life = 'create' else c_custkey is not null end""")
def command_feed(t):
    act = F.create_map(*[F.lit(x) for p in COMMANDS.items() for x in p])[F.col("event_type")]
    feed = t.events.select(
        F.col("user_id").alias("id"), "ts", "event_id", act.alias("act"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("email")).where("act is not null")
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    return ch.apply_commands(base, feed, "id", "act", "email", ["ts", "event_id"])


@query("partition_changes", """
    with o as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(year(o_orderdate) as int) as o_year from orders)
    select o_orderkey, o_custkey, o_orderstatus, case when o_year >= 1997 and o_orderstatus = 'P' then round(o_totalprice + 100, 2) else o_totalprice end as o_totalprice, o_year
    from o where not (o_year >= 1997 and o_orderstatus = 'F')
    union all select -o_orderkey, o_custkey, 'N', o_totalprice, 1900 from o where o_totalprice < 5000""")
def partition_changes(t):
    """Orders by year; one change set updates, deletes and inserts, and writes only the years that it touches."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("o_year"))
    path = fresh_path(t.spark, "orders-by-year")
    versions.create_partitioned(orders, path, "o_year")
    late = orders.where("o_year >= 1997 and o_orderstatus in ('P', 'F')").withColumn("gone", F.col("o_orderstatus") == "F")
    late = late.withColumn("o_totalprice", F.round(F.col("o_totalprice") + 100, 2))
    added = orders.where("o_totalprice < 5000").withColumns({"o_orderkey": -F.col("o_orderkey"), "o_orderstatus": F.lit("N"), "o_year": F.lit(1900), "gone": F.lit(False)})
    versions.change_partitioned(late.unionByName(added), path, "o_year", ["o_year", "o_orderkey"], "gone")
    return versions.read_version(t.spark, path, orders.schema)
