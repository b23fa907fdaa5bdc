"""Data-quality operators."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.catalog.registry import query
from loomwork.operators import quality as q
from loomwork.sources.text import lines_of

c = F.col


@query("row_errors", """
    select c_custkey, concat_ws(',', case when c_acctbal < 0 then 'balance below 0' end, case when c_nationkey not between 3 and 20 then 'nation out of range' end,
           case when length(c_mktsegment) < 9 then 'segment too short' end) as errors from customer""")
def row_errors(t):
    errors = q.all_errors([(c("c_acctbal") < 0, "balance below 0"), (~c("c_nationkey").between(3, 20), "nation out of range"),
                           (F.length("c_mktsegment") < 9, "segment too short")])
    return t.customer.select("c_custkey", F.array_join(errors, ",").alias("errors"))


NUMBER_LINES = """
    with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as raw from documents),
    n as (select doc_id, line_no, line_no || ', ' || length(raw) || case when length(raw) % 5 = 0 then ',' || string_split(raw, ' ')[1] else '' end as line from l),
    k as (select *, trim(string_split(line, ',')[3]) as third from n)
    select doc_id, line_no, third is null or try_cast(third as int) is not null as good,
           case when third is null then line_no + length(string_split(line, ',')[2]) * 0 + cast(trim(string_split(line, ',')[2]) as int) when try_cast(third as int) is not null
           then line_no + cast(trim(string_split(line, ',')[2]) as int) + cast(third as int) end as total,
           case when third is not null and try_cast(third as int) is null then 'not a number: ' || third end as cause from k"""


@query("bad_rows", NUMBER_LINES)
def bad_rows(t):
    # each document line becomes "line number, length" and, for some lengths, the first word as a third cell
    lines = lines_of(t.documents, "doc_id", "text").select("doc_id", (c("line_no") + 1).cast("bigint").alias("line_no"), c("line").alias("raw"))
    size = F.length("raw")
    text = F.concat(c("line_no").cast("string"), F.lit(", "), size.cast("string"),
                    F.when(size % 5 == 0, F.concat(F.lit(","), F.split("raw", " ")[0])).otherwise(""))
    good, bad = q.parse_number_lines(lines.select("doc_id", "line_no", text.alias("line")))
    total = F.aggregate("numbers", F.lit(0).cast("bigint"), lambda s, x: s + x)
    good = good.select("doc_id", "line_no", F.lit(True).alias("good"), total.alias("total"), F.lit(None).cast("string").alias("cause"))
    return good.unionByName(bad.select("doc_id", "line_no", F.lit(False).alias("good"), F.lit(None).cast("bigint").alias("total"), "cause"))


@query("rule_check", """
    select c_custkey, concat_ws(',', case when not c_acctbal between 0 and 9000 then 'Range failed for c_acctbal' end, case when length(c_mktsegment) > 9 then 'MaxLen failed for c_mktsegment' end,
           case when not regexp_full_match(c_mktsegment, '[A-M]+') then 'Pattern failed for c_mktsegment' end) as errors from customer""")
def rule_check(t):
    errors = q.rule_errors({"c_acctbal": [q.Range(0, 9000)], "c_mktsegment": [q.MaxLen(9), q.Pattern("[A-M]+")]})
    return t.customer.select("c_custkey", F.array_join(errors, ",").alias("errors"))


@query("schema_check", """
    select 'o_orderkey' as name, true as present, true as type_ok, count(*) filter (where o_orderkey is null) as nulls, null::varchar as problem from orders
    union all select 'o_totalprice', true, false, count(*) filter (where o_totalprice is null), 'type double' from orders
    union all select 'o_comment', false, false, null, null union all select 'o_clerk', false, false, null, 'missing'""")
def schema_check(t):
    declared = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_totalprice", T.DecimalType(18, 2)),
                             T.StructField("o_comment", T.StringType()), T.StructField("o_clerk", T.StringType())])
    return q.shape_report(t.orders, declared, optional=["o_comment"])


@query("email_check", r"""
    with w as (select doc_id, unnest(regexp_split_to_array(text, '\s+')) as word from documents)
    select doc_id, word, case when not contains(word, '@') then 'error' when not ends_with(word, '@example.com') then 'warning' else 'ok' end as status
    from w where word <> ''""")
def email_check(t):
    words = t.documents.select("doc_id", F.explode(F.split("text", r"\s+")).alias("word"))
    return words.where("word <> ''").withColumn("status", q.email_status(c("word"), "example.com"))


@query("positive_check", """
    select l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_extendedprice, l_discount) > 0 as positive from lineitem""")
def positive_check(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             q.all_positive(c("l_quantity"), c("l_extendedprice"), c("l_discount")).alias("positive"))
