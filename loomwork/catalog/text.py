"""String functions."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.functions import text as x

c = F.col


@query("str_clean", """
    select c_custkey, trim('  ' || c_name || ' ') as t, ltrim('  ' || c_name) as l, upper(c_name) as u, lower(c_mktsegment) as w,
           c_mktsegment[1] || lower(c_mktsegment[2:]) as title, nullif(trim(case when c_acctbal < 0 then '  ' else c_name end), '') as safe
    from customer""")
def str_clean(t):
    return t.customer.select(
        "c_custkey", x.clean(F.concat(F.lit("  "), c("c_name"), F.lit(" "))).alias("t"), F.ltrim(F.concat(F.lit("  "), c("c_name"))).alias("l"),
        F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("w"), F.initcap("c_mktsegment").alias("title"),
        F.nullif(x.clean(F.when(c("c_acctbal") < 0, "  ").otherwise(c("c_name"))), F.lit("")).alias("safe"))


@query("str_slice", """
    select c_custkey, left(c_name, 4) as a, right(c_name, 3) as b, substr(c_name, 10, 5) as c, length(c_name) as n, reverse(c_name) as r from customer""")
def str_slice(t):
    n = c("c_name")
    return t.customer.select("c_custkey", F.left(n, F.lit(4)).alias("a"), F.right(n, F.lit(3)).alias("b"), F.substring(n, 10, 5).alias("c"),
                             F.length(n).cast("bigint").alias("n"), F.reverse(n).alias("r"))


@query("str_position", "select page_id, instr(url, '?') as q, instr(url, '/en/') as en from pages")
def str_position(t):
    return t.pages.select("page_id", F.instr("url", "?").cast("bigint").alias("q"), F.instr("url", "/en/").cast("bigint").alias("en"))


@query("middle_field", """
    select event_id, event_type || ':' || user_id as code from events""")
def middle_field(t):
    value = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("|"), c("event_type"), F.lit(":"), c("user_id").cast("string"),
                     F.lit("|"), c("props"))
    return t.events.select("event_id", x.middle_field(value).alias("code"))


@query("template_fill", """
    select c_custkey, case when c_acctbal < 0 then null else 'Dear ' || c_name || ', segment ' || c_mktsegment || ' (' || c_mktsegment || '), band '
        || c_nationkey || '.' end as note from customer""")
def template_fill(t):
    text = F.lit("Dear {Name}, segment [%1] ([%1]), band %2.")
    band = F.when(c("c_acctbal") >= 0, c("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", x.fill(text, {"{Name}": c("c_name"), "[%1]": c("c_mktsegment"), "%2": band}).alias("note"))


@query("template_vars", """
    select p_partkey, p_type || ',' || replace(p_name, ' ', '_') as names from part""")
def template_vars(t):
    text = F.concat(F.lit("Hello {{"), c("p_type"), F.lit("}}, your {{"), F.replace(c("p_name"), F.lit(" "), F.lit("_")), F.lit("}} {{not this}}"))
    return t.part.select("p_partkey", F.array_join(x.template_names(text), ",").alias("names"))


@query("pad_mask", """
    select c_custkey, case when length(cast(c_custkey as varchar)) >= 3 then cast(c_custkey as varchar) else lpad(cast(c_custkey as varchar), 3, '0') end as id,
           rpad(c_mktsegment, 12, '123') as wide, repeat('*', length(c_name) - 4) || right(c_name, 4) as hidden, repeat('-', c_nationkey) as bar,
           right('00' || c_custkey, 3) as short from customer""")
def pad_mask(t):
    return t.customer.select("c_custkey", x.pad_start(c("c_custkey").cast("string"), 3, "0").alias("id"), x.pad_end(c("c_mktsegment"), 12, "123").alias("wide"),
                             x.mask(c("c_name")).alias("hidden"), F.repeat(F.lit("-"), c("c_nationkey")).alias("bar"),
                             x.zero_fill(c("c_custkey"), 3).alias("short"))


@query("split_fields", """
    select event_id, trim(string_split(trim(props, '{}'), ':')[1], '" ') as key, trim(string_split(trim(props, '{}'), ':')[2]) as value from events""")
def split_fields(t):
    pair = F.split(F.btrim("props", F.lit("{}")), ":", 2)
    return t.events.select("event_id", F.btrim(pair[0], F.lit('" ')).alias("key"), F.trim(pair[1]).alias("value"))


@query("queue_pop", """
    with q as (select o_orderkey, case when o_orderstatus = 'F' then o_orderpriority else o_orderpriority || '|' || o_orderstatus || '|' || o_custkey end as q from orders)
    select o_orderkey, case when contains(q, '|') then string_split(q, '|')[1] end as head,
           case when contains(q, '|') then substr(q, instr(q, '|') + 1) else q end as rest from q""")
def queue_pop(t):
    q = F.when(c("o_orderstatus") == "F", c("o_orderpriority")).otherwise(
        F.concat_ws("|", "o_orderpriority", "o_orderstatus", c("o_custkey").cast("string")))
    return t.orders.select("o_orderkey", x.queue_head(q).alias("head"), x.queue_rest(q).alias("rest"))


@query("concat_nulls", """
    select o_orderkey, o_orderpriority || '-' || c_name as strict, concat_ws('-', o_orderpriority, c_name) as loose
    from orders left join (select * from customer where c_acctbal > 5000) on o_custkey = c_custkey""")
def concat_nulls(t):
    both = t.orders.join(t.customer.where("c_acctbal > 5000"), c("o_custkey") == c("c_custkey"), "left")
    return both.select("o_orderkey", F.concat("o_orderpriority", F.lit("-"), "c_name").alias("strict"),
                       F.concat_ws("-", "o_orderpriority", "c_name").alias("loose"))


@query("html_escape", """
    select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as safe from pages""")
def html_escape(t):
    return t.pages.select("page_id", x.escape_html(c("html")).alias("safe"))


@query("url_endpoint", """
    select page_id, coalesce(string_split(case when contains(url, '/de/') then null else url end, '?')[1], 'NA') as endpoint from pages""")
def url_endpoint(t):
    url = F.when(~c("url").contains("/de/"), c("url"))
    return t.pages.select("page_id", x.endpoint(url).alias("endpoint"))


@query("query_params", """
    with p as (select page_id, regexp_extract(url, '\\?([^#]*)', 1) as q from pages),
    e as (select page_id, unnest(string_split(q, '&')) as e, generate_subscripts(string_split(q, '&'), 1) as i from p where q <> '')
    select page_id, string_split(e, '=')[1] as name, arg_max(coalesce(string_split(e, '=')[2], ''), i) as value from e group by 1, 2""")
def query_params(t):
    return t.pages.select("page_id", F.explode(x.query_map(c("url"))).alias("name", "value"))


@query("regex_extract", r"""
    select doc_id, regexp_extract(text, '(\d{4})-(\d{2})-(\d{2})', 1) as year, regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') as mail,
           len(regexp_extract_all(text, '\d+')) as numbers, regexp_extract(text, '^(\S+) (\S+)', 2) as second from documents""")
def regex_extract(t):
    return t.documents.select("doc_id", F.regexp_extract("text", r"(\d{4})-(\d{2})-(\d{2})", 1).alias("year"),
                              c("text").rlike(r"[a-z0-9.]+@[a-z0-9.]+").alias("mail"),
                              F.size(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))).cast("bigint").alias("numbers"),
                              F.regexp_extract("text", r"^(\S+) (\S+)", 2).alias("second"))


@query("regex_advanced", r"""
    select doc_id, regexp_extract(text, '\$(\d+(?:\.\d+)?)', 1) as price, regexp_matches(text, '(?s)^\S.*\.\s*$') as whole_sentence,
           len(regexp_extract_all(text, '\p{L}')) - len(regexp_extract_all(text, '[A-Za-z]')) as non_ascii_letters from documents""")
def regex_advanced(t):
    # look-behind, dot-all and a class intersection; the SQL says the same without them
    return t.documents.select(
        "doc_id", F.regexp_extract("text", r"(?<=\$)\d+(?:\.\d+)?", 0).alias("price"),
        c("text").rlike(r"(?s)^\S.*\.\s*$").alias("whole_sentence"),
        F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}&&[^\p{ASCII}]]"), F.lit(0))).cast("bigint").alias("non_ascii_letters"))


@query("regex_repeated_word", r"""
    with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]+') as p from documents),
    n as (select doc_id, unnest(p) as a, generate_subscripts(p, 1) as i, p from w)
    select doc_id, bool_or(regexp_full_match(a, '\p{L}+') and i + 2 <= len(p) and regexp_full_match(p[i + 1], '\s+') and p[i + 2] = a) as repeated_word from n group by doc_id""")
def regex_repeated_word(t):
    # a named back-reference between word edges; DuckDB's patterns have none, so its SQL compares neighbouring words
    return t.documents.select("doc_id", c("text").rlike(r"(?iu)(?<![\p{L}\p{N}_])(?<w>\p{L}+)\s+\k<w>(?![\p{L}\p{N}_])").alias("repeated_word"))


@query("regex_rewrite", """
    select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as day, '[' || string_split(o_orderpriority, '-')[1] || ']-' ||
           regexp_replace(string_split(o_orderpriority, '-')[2], '([A-Z]+)', '[\\1]', 'g') as boxed from orders""")
def regex_rewrite(t):
    return t.orders.select("o_orderkey", F.regexp_replace(F.date_format("o_orderdate", "yyyy-MM-dd"), r"(\d{4})-(\d{2})-(\d{2})", "$3/$2/$1").alias("day"),
                           F.regexp_replace("o_orderpriority", r"(\w+)", r"[$1]").alias("boxed"))


@query("char_codes", "select n_nationkey, ascii(n_name) as code, chr(65 + n_nationkey) as letter from nation")
def char_codes(t):
    return t.nation.select("n_nationkey", F.ascii("n_name").alias("code"), F.chr(F.lit(65) + c("n_nationkey")).alias("letter"))


@query("encode_bytes", """
    select c_custkey, base64(encode(c_name)) as b64, hex(c_name) as hx, c_name as back, c_name as back_hex from customer""")
def encode_bytes(t):
    b64, hx = F.base64(F.encode("c_name", "UTF-8")), F.hex(F.encode("c_name", "UTF-8"))
    return t.customer.select("c_custkey", b64.alias("b64"), hx.alias("hx"), F.decode(F.unbase64(b64), "UTF-8").alias("back"),
                             F.decode(F.unhex(hx), "UTF-8").alias("back_hex"))


@query("utf8_repair", """
    select doc_id, false as valid_before, true as valid_after, text || chr(65533) || '!' as text from documents""")
def utf8_repair(t):
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")), F.encode(F.lit("!"), "UTF-8"))
    fixed = x.repaired(broken)
    return t.documents.select("doc_id", F.is_valid_utf8(broken.cast("string")).alias("valid_before"),
                              F.is_valid_utf8(fixed).alias("valid_after"), fixed.alias("text"))


@query("number_format", """
    select p_partkey, printf('%.2f', p_retailprice) as fixed, printf('%.3e', p_retailprice) as sci, format('{:,}', p_partkey * 1000) as thousands,
           lpad(bin(p_size), 8, '0') as binary, printf('%o', p_size) as octal, lpad(lower(hex(p_size)), 4, '0') as hexa from part""")
def number_format(t):
    price, size = c("p_retailprice"), c("p_size")
    return t.part.select(
        "p_partkey", F.format_string("%.2f", price).alias("fixed"), F.format_string("%.3e", price).alias("sci"),
        F.format_number(c("p_partkey") * 1000, 0).alias("thousands"), x.pad_start(F.bin(size), 8, "0").alias("binary"),
        F.conv(size.cast("string"), 10, 8).alias("octal"), x.pad_start(F.lower(F.hex(size)), 4, "0").alias("hexa"))


@query("format_bytes", """
    with s as (select doc_id, n_chars * n_chars as n from documents),
    u as (select *, case when n < 1024 then 1 when n < 1048576 then 1024 when n < 1073741824 then 1048576 else 1073741824 end as d from s)
    select doc_id, printf('%.1f', floor(n::double / d * 10 + 0.5) / 10) || case d when 1 then ' B' when 1024 then ' KB' when 1048576 then ' MB' else ' GB' end as size from u""")
def format_bytes(t):
    return t.documents.select("doc_id", x.size_text(c("n_chars") * c("n_chars")).alias("size"))
