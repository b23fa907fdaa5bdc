"""Aggregations."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import numbered_sql, query, rollup_sql
from loomwork.catalog.joins import PARAMS, order_params
from loomwork.operators import aggregates as a
from loomwork.operators.hot import collect_ordered


@query("token_rollup", rollup_sql("select *, cast(l_partkey as varchar) as part_key from lineitem", "l_orderkey", {"part_key": True, "l_linestatus": False, "l_returnflag": True}))
def token_rollup(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("part_key"), "l_linestatus", "l_returnflag")
    return a.rollup_text(rows, ["l_orderkey"], {"part_key": True, "l_linestatus": False, "l_returnflag": True})


@query("count_distinct", """
    select count(distinct l_orderkey) as tokens, count(distinct l_orderkey) filter (where l_returnflag <> 'R') as other_tokens
    from lineitem""")
def count_distinct(t):
    return t.lineitem.agg(F.countDistinct("l_orderkey").alias("tokens"),
                          F.countDistinct(F.when(F.col("l_returnflag") != "R", F.col("l_orderkey"))).alias("other_tokens"))


@query("collect_list_set", rollup_sql("select * from orders", "o_custkey", {"o_orderstatus": False, "o_orderpriority": True}))
def collect_list_set(t):
    return a.rollup_text(t.orders, ["o_custkey"], {"o_orderstatus": False, "o_orderpriority": True})


@query("max_text", "select o_custkey, max(cast(o_orderkey as varchar)) as top from orders group by o_custkey")
def max_text(t):
    return t.orders.groupBy("o_custkey").agg(F.max(F.col("o_orderkey").cast("string")).alias("top"))


@query("conditional_counts", """
    select l_orderkey, count(*) as ports, count(*) filter (where l_linestatus = 'O') as working,
           count(*) filter (where l_linestatus = 'O' and l_returnflag like 'R%') as returned from lineitem group by l_orderkey""")
def conditional_counts(t):
    open_ = F.col("l_linestatus") == "O"
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("ports"), F.count_if(open_).alias("working"),
        F.count_if(open_ & F.col("l_returnflag").like("R%")).alias("returned"))


@query("basic_aggs", """
    select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, min(l_quantity) as min_qty,
           max(l_extendedprice) as max_price, round(avg(l_quantity), 4) as avg_qty, count(*) as n
    from lineitem group by l_returnflag, l_linestatus""")
def basic_aggs(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
        F.min("l_quantity").alias("min_qty"), F.max("l_extendedprice").alias("max_price"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("avg_or_zero", """
    select c_custkey, coalesce(n, 0) as n, round(coalesce(mean, 0), 7) as mean from customer left join
    (select o_custkey, count(*) as n, sum(cast(o_totalprice as decimal(18,2)))::double / count(*) as mean from orders where o_orderpriority = '1-URGENT' group by o_custkey)
    on c_custkey = o_custkey""")
def avg_or_zero(t):
    # aggregate first, then join: one row per customer reaches the join
    per = (t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey")
           .agg(F.count(F.lit(1)).alias("n"), a.mean_or_zero(F.col("o_totalprice").cast("decimal(18,2)")).alias("mean")))
    return (t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"),
                    F.round(F.coalesce("mean", F.lit(0.0)), 7).alias("mean")))


@query("group_by_bucket", """
    select case when p_size = 0 then 'none' when p_size < 10 then 'low' when p_size < 30 then 'medium' else 'high' end as stock,
           p_type as kind, count(*) as n, sum(p_size) ::bigint as pieces from part group by all""")
def group_by_bucket(t):
    s = F.col("p_size")
    stock = F.when(s == 0, "none").when(s < 10, "low").when(s < 30, "medium").otherwise("high")
    grouped = t.part.groupBy(F.struct(stock.alias("stock"), F.col("p_type").alias("kind")).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("pieces"))
    return grouped.select("k.stock", "k.kind", "n", "pieces")


@query("string_agg", "select r_name, part_no, string_agg(n_name, ', ' order by n_name) as nations from "
       + numbered_sql("nation join region on n_regionkey = r_regionkey", "r_name", "n_name") + " group by r_name, part_no")
def string_agg(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (collect_ordered(rows, ["r_name"], ["n_name"], F.col("n_name"))
            .select("r_name", "part_no", F.array_join("items", ", ").alias("nations")))


@query("group_members", "select letter, part_no, count(*) as n, string_agg(p_name, ',' order by p_partkey) as members from "
       + numbered_sql("(select *, upper(p_name[1]) as letter from part)", "letter", "p_partkey") + " group by letter, part_no")
def group_members(t):
    rows = t.part.select(F.upper(F.substring("p_name", 1, 1)).alias("letter"), "p_partkey", "p_name")
    return (collect_ordered(rows, ["letter"], ["p_partkey"], F.col("p_name"))
            .select("letter", "part_no", F.size("items").cast("bigint").alias("n"), F.array_join("items", ",").alias("members")))


@query("word_count", r"""
    select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '\s+')) as word from documents)
    where word <> '' group by word""")
def word_count(t):
    return a.frequencies(a.words(t.documents, "text"), "word")


@query("distinct_values", "select distinct o_custkey, o_orderstatus from orders")
def distinct_values(t):
    return t.orders.select("o_custkey", "o_orderstatus").distinct()


@query("any_flag", """
    select user_id, case when bool_or(event_type = 'error' and cast(json_extract_string(props, '$.k') as int) in (7, 9, 11))
    then 'Y' else 'N' end as missed from events group by user_id""")
def any_flag(t):
    code = F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k"))
    return t.events.groupBy("user_id").agg(a.any_of(code, ["7", "9", "11"]).alias("missed"))


@query("count_variant", """
    select user_id, count(*) filter (where event_type = 'purchase') as bought, count(*) filter (where event_type <> 'error') as fine
    from events group by user_id""")
def count_variant(t):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.count_if(kind == "purchase").alias("bought"), F.count_if(kind != "error").alias("fine"))


@query("split_outcomes", """
    select user_id, case event_type when 'error' then 'rejected' else 'fulfilled' end as status, count(*) as n,
           round(sum(case when event_type <> 'error' then value end), 4) as total,
           count(distinct case when event_type = 'error' then 'code ' || json_extract_string(props, '$.k') end) as reasons
    from events group by 1, 2""")
def split_outcomes(t):
    rows = a.split_outcomes(t.events, F.col("event_type") != "error", F.col("value"),
                            F.concat(F.lit("code "), F.get_json_object("props", "$.k")))
    return rows.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value_out"), 4).alias("total"),
                                                 F.countDistinct("reason").alias("reasons"))


@query("errors_by_kind", "select kind, part_no, count(*) as n, string_agg(event_id, ',' order by event_id) as events from "
       + numbered_sql("(select *, cast(json_extract_string(props, '$.k') as int) // 10 as kind from events where event_type = 'error')", "kind", "event_id") + " group by kind, part_no")
def errors_by_kind(t):
    kind = F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int")
    rows = t.events.where("event_type = 'error'").select(kind.alias("kind"), "event_id")
    return (collect_ordered(rows, ["kind"], ["event_id"], F.col("event_id").cast("string"))
            .select("kind", "part_no", F.size("items").cast("bigint").alias("n"), F.array_join("items", ",").alias("events")))


@query("eav_pivot", "with" + PARAMS + """
    select order_number, max(case when name = 'BundleId' then value end) as BundleId,
           max(case when name = 'Arrivalslot' then value end) as Arrivalslot from params group by order_number""")
def eav_pivot(t):
    return a.to_wide(order_params(t), "order_number", "name", "value", ["BundleId", "Arrivalslot"])


@query("max_record", """
    select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders
    qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) = 1""")
def max_record(t):
    top = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", "o_orderkey", "o_orderstatus")).alias("m"))
    return top.select("o_custkey", "m.o_orderkey", "m.o_totalprice", "m.o_orderstatus")


ACTIONS = """
    acts as (select user_id, ts, event_id, cast(json_extract_string(props, '$.k') as int) as item, value as price,
             case event_type when 'purchase' then 'add' when 'click' then 'remove' when 'error' then 'clear' end as act
             from events where event_type in ('purchase', 'click', 'error')),
    kept as (select * from acts a where not exists (select 1 from acts c where c.user_id = a.user_id and c.act = 'clear'
             and (c.ts, c.event_id) >= (a.ts, a.event_id))),"""


def cart_actions(events):
    action = F.create_map(*[F.lit(x) for x in ("purchase", "add", "click", "remove", "error", "clear")])[F.col("event_type")]
    return events.select("user_id", "ts", "event_id", action.alias("act"),
                           F.get_json_object("props", "$.k").cast("int").alias("item"), F.col("value").alias("price"))


@query("event_fold", "with" + ACTIONS + """
    seg as (select *, sum(case when act = 'remove' then 1 else 0 end) over (partition by user_id, item order by ts, event_id
            rows between unbounded preceding and current row) - case when act = 'remove' then 1 else 0 end as s from kept),
    st as (select user_id, item, s, sum(price) filter (where act = 'add') as total, count(*) filter (where act = 'add') as n,
           bool_or(act = 'remove') as closed, arg_min(price, (ts, event_id)) filter (where act = 'add') as first
           from seg group by user_id, item, s),
    e as (select user_id, sum(case when closed then 0 else n end)::bigint as items,
          sum(coalesce(total, 0) - case when closed then coalesce(first, 0) else 0 end) as total from st group by user_id)
    select u.user_id, coalesce(items, 0) as items, round(coalesce(total, 0), 2) + 0.0 as total
    from (select distinct user_id from events) u left join e on u.user_id = e.user_id""")
def event_fold(t):
    return (a.cart_totals(cart_actions(t.events), "user_id", ["ts", "event_id"], "act", "item", "price")
            .withColumn("total", F.round("total", 2) + F.lit(0.0)))


@query("ordered_fold", """
    select l_orderkey, round(sum(l_quantity * pos), 2) as weighted, arg_max(l_quantity, pos) as last_qty from
    (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as pos from lineitem)
    group by l_orderkey""")
def ordered_fold(t):
    from loomwork.operators.hot import numbered
    # a fold in row order, written as sums over the numbered rows: acc + position * quantity, and the last value
    rows = numbered(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"],
                    ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "pos")
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("pos")), 2).alias("weighted"),
                                          F.max_by("l_quantity", "pos").alias("last_qty"))


@query("discounted_total", """
    select l_orderkey, round(sum(l_extendedprice * l_quantity) * 0.9, 4) as total, round(sum(l_extendedprice * (1 - l_discount)), 4) as net
    from lineitem group by l_orderkey""")
def discounted_total(t):
    price = F.col("l_extendedprice")
    return t.lineitem.groupBy("l_orderkey").agg(
        F.round(F.sum(price * F.col("l_quantity")) * 0.9, 4).alias("total"),
        F.round(F.sum(price * (1 - F.col("l_discount"))), 4).alias("net"))
