"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.operators.hot import numbered
from loomwork.session import fresh_path
from loomwork.sources import tables as tb
from loomwork.sources import text as tx

RUN_TS = "2024-05-23 08:00:00"


@query("csv_external_scan", """
    select cast(o_orderkey as varchar) o_orderkey, cast(o_custkey as varchar) o_custkey, o_orderstatus,
           cast(cast(o_totalprice as decimal(18,2)) as varchar) o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') o_orderdate, o_orderpriority
    from orders""")
def csv_external_scan(t):
    path = fresh_path(t.spark, "orders_csv")
    tb.write_delimited(t.orders.withColumns({
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
        "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")}), path)
    return tb.read_delimited(t.spark, path, t.orders.columns)


@query("table_scan", "select * from supplier")
def table_scan(t):
    return t.supplier


@query("ctas_roundtrip", """
    select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate from lineitem where l_returnflag <> 'R'""")
def ctas_roundtrip(t):
    rows = (t.lineitem.where("l_returnflag <> 'R'")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"))
    return tb.create_table(rows, fresh_path(t.spark, "ctas"))


@query("rebuild_run", "select o_orderkey, o_orderstatus, '2024052308' as run from orders where o_orderstatus = 'O'")
def rebuild_run(t):
    run = "2024052308"
    path = f"{fresh_path(t.spark, 'run')}_{run}"
    rows = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus", F.lit(run).alias("run"))
    tb.create_table(rows, path)
    return tb.create_table(rows, path)


@query("audit_append", """
    select user_id as owner, 'KSUDelay-' || cast(1000 + row_number() over (order by ts, event_id) as varchar) as name,
           '2024-05-23T08:00:00|' || event_type || '|' || props as value
    from events where event_type = 'error'""")
def audit_append(t):
    path = fresh_path(t.spark, "audit")
    rows = numbered(t.events.where("event_type = 'error'"), [], ["ts", "event_id"], "seq")
    rows = rows.withColumn("seq", F.col("seq") + 1000)
    tb.append_rows(tb.audit_rows(rows, "user_id", "seq", F.col("event_type"), F.col("props"), RUN_TS), path)
    return t.spark.read.parquet(path)


@query("text_lines", """
    select upper(replace(unnest(string_split(text, chr(10))), 'ß', 'ss')) as line from documents""")
def text_lines(t):
    source, target = fresh_path(t.spark, "lines"), fresh_path(t.spark, "upper")
    tx.write_lines(tx.lines_of(t.documents, "doc_id", "text"), source)
    tx.write_lines(tx.read_lines(t.spark, source).select(F.upper("line").alias("line")), target)
    return tx.read_lines(t.spark, target)


@query("log_sink", """
    select ts, case event_type when 'error' then 'ERROR' else 'WARNING' end as level,
           '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || event_type || ' by ' || user_id as message
    from events where event_type in ('error', 'purchase')""")
def log_sink(t):
    path = fresh_path(t.spark, "log")
    level = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING")
             .when(F.col("event_type") == "signup", "INFO").otherwise("DEBUG"))
    message = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "event_type",
                       F.lit(" by "), F.col("user_id").cast("string"))
    log = t.events.select("ts", level.alias("level"), message.alias("message"))
    tb.append_rows(log.where("ts < '2024-01-16'"), path)
    tb.append_rows(log.where("ts >= '2024-01-16'"), path)
    return tx.at_least(t.spark.read.parquet(path), "WARNING")


# The documents become config text: a line whose first word has six letters or
# more is a section header, any other line is first word = rest.
CONFIG_SQL = """
    with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no,
                      unnest(string_split(text, chr(10))) as raw from documents),
    c as (select doc_id, line_no, string_split(raw, ' ')[1] as head, raw from l),
    d as (select doc_id, line_no, case when length(head) >= 6 then head end as own,
                 head as key, substr(raw, length(head) + 2) as value from c),
    e as (select *, coalesce(last_value(own ignore nulls) over w, 'default') as section,
                 coalesce(last_value(case when own is not null then line_no end ignore nulls) over w, -1) as since
          from d window w as (partition by doc_id order by line_no rows between unbounded preceding and current row)),
    f as (select doc_id, own, max(line_no) as renewed from d where own is not null group by doc_id, own)
    select e.doc_id, section, trim(key) as key, trim(arg_max(value, line_no)) as value
    from e left join f on e.doc_id = f.doc_id and e.section = f.own
    where e.own is null and (renewed is null or since = renewed) group by e.doc_id, section, trim(key)"""


@query("section_config", CONFIG_SQL)
def section_config(t):
    lines = tx.lines_of(t.documents, "doc_id", "text")
    head = F.split("line", " ")[0]
    rest = F.expr("substring(line, length(split(line, ' ')[0]) + 2)")
    text = F.when(F.length(head) >= 6, F.concat(F.lit("["), head, F.lit("]"))).otherwise(
        F.concat(head, F.lit("="), rest))
    return tx.parse_sections(lines.withColumn("line", text), "doc_id")


@query("paging", """
    select o_orderkey, cast((row_number() over (order by o_orderdate, o_orderkey) - 1) // 250 as bigint) as page,
           (row_number() over (order by o_orderdate, o_orderkey) - 1) % 250 + 1 as row_in_page from orders""")
def paging(t):
    return tb.pages(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 250).drop("o_orderdate")


@query("inline_rows", """
    select v.code, v.weight, count(*) as orders
    from (values ('1-URGENT', 5), ('2-HIGH', 3), ('5-LOW', 1)) v(code, weight)
    join orders on o_orderpriority = v.code group by v.code, v.weight""")
def inline_rows(t):
    rows = t.spark.createDataFrame([("1-URGENT", 5), ("2-HIGH", 3), ("5-LOW", 1)], "code string, weight int")
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("orders"))
    return counts.join(F.broadcast(rows), "code").select("code", "weight", "orders")
