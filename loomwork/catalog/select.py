"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.functions import values as v


@query("star_flag", """
    select a.*, b.c_name, b.c_nationkey, case when b.c_custkey is not null then 'Y' else 'N' end as known
    from orders a left join (select * from customer where c_acctbal > 0) b on a.o_custkey = b.c_custkey""")
def star_flag(t):
    a, b = t.orders.alias("a"), t.customer.where("c_acctbal > 0").alias("b")
    return (a.join(b, F.col("a.o_custkey") == F.col("b.c_custkey"), "left")
            .select("a.*", "b.c_name", "b.c_nationkey",
                    F.when(F.col("b.c_custkey").isNotNull(), "Y").otherwise("N").alias("known")))


@query("rename_drop", "select c_custkey as user_id, c_name as user_name, c_nationkey, c_mktsegment from customer")
def rename_drop(t):
    return t.customer.withColumnsRenamed({"c_custkey": "user_id", "c_name": "user_name"}).drop("c_acctbal")


@query("nested_default", """
    select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k,
           coalesce(json_extract_string(props, '$.address.city'), 'unknown') as city from events""")
def nested_default(t):
    props = F.from_json("props", "k string, address struct<city:string,country:string>")
    row = t.events.select("event_id", props.alias("p"))
    return row.select("event_id", v.present_or(F.col("p.k"), F.lit("none")).alias("k"),
                      v.present_or(F.col("p.address.city"), F.lit("unknown")).alias("city"))


@query("null_default", """
    select o_orderkey, coalesce(case when o_orderstatus = 'P' then null else o_orderpriority end, 'open') as priority,
           coalesce(case when o_orderstatus = 'F' then 0 end, case when o_totalprice > 100000 then 1 end, 2) as tier
    from orders""")
def null_default(t):
    return t.orders.select(
        "o_orderkey",
        v.present_or(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.lit("open")).alias("priority"),
        v.present_or(F.when(F.col("o_orderstatus") == "F", 0), F.when(F.col("o_totalprice") > 100000, 1),
                     F.lit(2)).alias("tier"))


@query("falsy_default", """
    select l_orderkey, l_linenumber, l_partkey,
           case when l_discount is null or l_discount = 0 then 0.01 else l_discount end::double as discount from lineitem""")
def falsy_default(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             v.truthy_or(F.col("l_discount"), F.lit(0.01)).alias("discount"))


@query("transform_if_present", """
    select c_custkey, case when s is not null and s <> '' then lower(s) else s end as session
    from (select c_custkey, case when c_acctbal < 0 then null when c_nationkey = 0 then '' else c_mktsegment end as s
          from customer)""")
def transform_if_present(t):
    s = (F.when(F.col("c_acctbal") < 0, None).when(F.col("c_nationkey") == 0, "").otherwise(F.col("c_mktsegment")))
    return t.customer.select("c_custkey", v.if_present(s, F.lower).alias("session"))


@query("blank_test", """
    select doc_id, count(*) filter (where trim(coalesce(line, '')) = '') as blank, count(*) as lines
    from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by doc_id""")
def blank_test(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(v.is_blank(F.col("line"))).alias("blank"),
                                       F.count(F.lit(1)).alias("lines"))


@query("bool_filter", """
    select l_orderkey, l_linenumber, l_quantity from lineitem
    where (l_returnflag = 'R' and l_linestatus <> 'F') or (l_quantity >= 45 and not l_discount > 0.05)""")
def bool_filter(t):
    c = F.col
    return t.lineitem.where(((c("l_returnflag") == "R") & (c("l_linestatus") != "F"))
                            | ((c("l_quantity") >= 45) & ~(c("l_discount") > 0.05))
                            ).select("l_orderkey", "l_linenumber", "l_quantity")


@query("in_list", """
    select o_orderkey, o_orderpriority, o_orderstatus in ('O', 'P') as open from orders
    where o_orderpriority not in ('1-URGENT', '5-LOW')""")
def in_list(t):
    return (t.orders.where(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
            .select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").isin("O", "P").alias("open")))


@query("like_match", """
    select p_partkey, p_type like '%O%' as has_o, starts_with(p_type, 'S') as starts_s, contains(p_name, 'ring') as ring
    from part where p_type like '%M%' or p_name like 'red%'""")
def like_match(t):
    c = F.col
    return (t.part.where(c("p_type").like("%M%") | c("p_name").like("red%"))
            .select("p_partkey", c("p_type").like("%O%").alias("has_o"), c("p_type").startswith("S").alias("starts_s"),
                    c("p_name").contains("ring").alias("ring")))


@query("csv_membership", """
    select o_orderkey, o_orderstatus, stages,
           coalesce(stages, '') = '' or ',' || stages || ',' like '%,' || o_orderstatus || ',%' as valid
    from orders join (values ('1-URGENT', 'O,P'), ('2-HIGH', ''), ('3-MEDIUM', null), ('4-NOT SPECIFIED', 'F'),
                             ('5-LOW', 'P,F,O')) s(priority, stages) on o_orderpriority = priority""")
def csv_membership(t):
    stages = t.spark.createDataFrame([("1-URGENT", "O,P"), ("2-HIGH", ""), ("3-MEDIUM", None),
                                      ("4-NOT SPECIFIED", "F"), ("5-LOW", "P,F,O")], "priority string, stages string")
    both = t.orders.join(F.broadcast(stages), F.col("o_orderpriority") == F.col("priority"))
    return both.select("o_orderkey", "o_orderstatus", "stages",
                       v.in_text_list(F.col("stages"), F.col("o_orderstatus")).alias("valid"))


@query("ci_match", """
    select c_custkey, c_mktsegment from customer
    where upper(lower(c_mktsegment)) in ('BUILDING', 'MACHINERY') or contains(lower(c_name), '#00000001')""")
def ci_match(t):
    return (t.customer.where(v.one_of_ignoring_case(F.lower("c_mktsegment"), ["building", "Machinery"])
                             | v.contains_ignoring_case(F.col("c_name"), "#00000001"))
            .select("c_custkey", "c_mktsegment"))


@query("computed_filter", """
    select p_partkey, round(p_retailprice * p_size / 10, 2) as r from part where round(p_retailprice * p_size / 10, 2) > 2000""")
def computed_filter(t):
    return (t.part.select("p_partkey", F.round(F.col("p_retailprice") * F.col("p_size") / 10, 2).alias("r"))
            .where("r > 2000"))


@query("literal_classify", """
    select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'finished' else 'other' end as status
    from orders""")
def literal_classify(t):
    return t.orders.select("o_orderkey", v.by_literal(F.col("o_orderstatus"), {"O": "open", "F": "finished"},
                                                      "other").alias("status"))


@query("guarded_classify", """
    select l_orderkey, l_linenumber, l_partkey,
           case when l_extendedprice > 90000 and l_discount >= 0.08 then 'review' when l_extendedprice > 50000 then 'high'
                when l_extendedprice > 10000 then 'medium' when l_returnflag = 'R' then 'returned' else 'low' end as band
    from lineitem""")
def guarded_classify(t):
    price = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", v.first_match([
        ((price > 90000) & (F.col("l_discount") >= 0.08), "review"), (price > 50000, "high"),
        (price > 10000, "medium"), (F.col("l_returnflag") == "R", "returned")], "low").alias("band"))


@query("event_classify", """
    select event_id, case when event_type = 'purchase' and value > 100 then 'large purchase by ' || user_id
        when event_type = 'purchase' then 'purchase' when event_type = 'error' and
        cast(json_extract_string(props, '$.k') as int) >= 50 then 'severe error'
        when event_type = 'error' then 'error' when event_type in ('view', 'click') then 'activity'
        else 'unknown: ' || event_type end as note from events""")
def event_classify(t):
    return t.events.select("event_id", event_note().alias("note"))


def event_note():
    """Text of an event: the type decides, then its own fields. First match wins."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").try_cast("int")
    return v.first_match([
        ((kind == "purchase") & (F.col("value") > 100), F.concat(F.lit("large purchase by "), F.col("user_id").cast("string"))),
        (kind == "purchase", "purchase"),
        ((kind == "error") & (k >= 50), "severe error"),
        (kind == "error", "error"),
        (kind.isin("view", "click"), "activity")], F.concat(F.lit("unknown: "), kind))


@query("array_pattern", """
    select doc_id, case when len(w) = 0 then 'empty' when len(w) = 1 then 'one:' || w[1]
        when lower(w[1]) = 'the' and len(w) = 2 then 'the:' || w[2]
        when lower(w[1]) = 'the' then 'the+' || cast(len(w) - 1 as varchar)
        when len(w) = 3 then w[1] || '/' || w[3] else 'other' end as pattern
    from (select doc_id, string_split(line, ' ') as w from
          (select doc_id, unnest(string_split(text, chr(10))) as line from documents))""")
def array_pattern(t):
    rows = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.select("doc_id", F.split("line", " ").alias("w"))
    n, at = F.size("w"), lambda i: F.try_element_at("w", F.lit(i))
    return rows.select("doc_id", v.first_match([
        (n == 0, "empty"), (n == 1, F.concat(F.lit("one:"), at(1))),
        ((F.lower(at(1)) == "the") & (n == 2), F.concat(F.lit("the:"), at(2))),
        (F.lower(at(1)) == "the", F.concat(F.lit("the+"), F.size(F.slice("w", 2, n)).cast("string"))),
        (n == 3, F.concat(at(1), F.lit("/"), at(3)))], "other").alias("pattern"))


@query("safe_parse", """
    select event_id, coalesce(try_cast(substr(release, 2, 5) as int), 99999) as release_no
    from (select event_id, case when event_type = 'view' then 'Rx' || event_id else
                 'R' || json_extract_string(props, '$.k') || '00' end as release from events)""")
def safe_parse(t):
    release = F.when(F.col("event_type") == "view", F.concat(F.lit("Rx"), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("R"), F.get_json_object("props", "$.k"), F.lit("00")))
    return t.events.select("event_id", v.as_int_or(F.substring(release, 2, 5), 99999).alias("release_no"))


@query("with_field", """
    select n_nationkey, lower(n_name) as n_name, n_regionkey, true as processed, n_nationkey || ':' || 99 as point from nation""")
def with_field(t):
    point = F.struct(F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y")).withField("y", F.lit(99))
    return (t.nation.withColumns({"p": point, "n_name": F.lower("n_name"), "processed": F.lit(True)})
            .withColumn("point", F.concat_ws(":", F.col("p.x").cast("string"), F.col("p.y").cast("string"))).drop("p"))


@query("struct_equal", """
    select a.o_orderkey, a.o_custkey is not distinct from b.c2 and a.o_orderstatus is not distinct from b.s2
        and a.o_totalprice is not distinct from b.p2 as same
    from orders a join (select o_orderkey as k2, o_custkey as c2, case when o_orderpriority = '5-LOW' then null
        else o_orderstatus end as s2, o_totalprice as p2 from orders) b on a.o_orderkey = b.k2""")
def struct_equal(t):
    fields = ["o_custkey", "o_orderstatus", "o_totalprice"]
    other = t.orders.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")))
    left = t.orders.select("o_orderkey", F.struct(*fields).alias("x"))
    right = other.select("o_orderkey", F.struct(*fields).alias("y"))
    return left.join(right, "o_orderkey").select("o_orderkey", v.same_row(F.col("x"), F.col("y")).alias("same"))
