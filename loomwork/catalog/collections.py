"""Array and map functions."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import numbered_sql, query
from loomwork.functions import collections as x
from loomwork.operators.hot import collect_ordered

c = F.col
LINES = """
    w as (select doc_id, line_no, string_split(line, ' ') as w from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no,
          unnest(string_split(text, chr(10))) as line from documents))"""


def line_words(t):
    """Each line of a document as an array of words."""
    return (t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .select("doc_id", c("line_no").cast("bigint").alias("line_no"), F.split("line", " ").alias("w")))


@query("array_hof", "with" + LINES + """
    select doc_id, line_no, array_to_string(list_transform(list_filter(w, lambda x: length(x) > 4), lambda x: upper(replace(x, 'ß', 'ss'))), ' ') as long_words,
           list_sum(list_transform(w, lambda x: length(x)))::bigint as letters from w""")
def array_hof(t):
    w = c("w")
    return line_words(t).select(
        "doc_id", "line_no", F.array_join(F.transform(F.filter(w, lambda s: F.length(s) > 4), F.upper), " ").alias("long_words"),
        F.aggregate(w, F.lit(0).cast("bigint"), lambda n, s: n + F.length(s)).alias("letters"))


@query("array_flatten", """
    select o_orderkey, concat_ws(',', o_orderkey, o_custkey, nullif(o_orderkey, o_custkey), o_orderkey + 1, o_custkey + 1) as flat,
           concat_ws(',', case when o_orderstatus <> 'F' then o_custkey end, o_orderkey) as solid from orders""")
def array_flatten(t):
    k, u = c("o_orderkey"), c("o_custkey")
    nested = F.array(F.array(F.array(k, u), F.array(F.nullif(k, u))), F.array(F.array(k + 1, u + 1)))
    holes = F.array(F.when(c("o_orderstatus") != "F", u), F.lit(None).cast("bigint"), k)
    return t.orders.select("o_orderkey", F.array_join(x.flat(nested, 2), ",").alias("flat"),
                           F.array_join(x.without_holes(holes), ",").alias("solid"))


@query("flat_map", "with" + LINES + """
    select length(x) * 2 as doubled, count(*) as n from (select unnest(w) as x from w) where length(x) % 2 = 0 group by 1""")
def flat_map(t):
    even = F.transform(c("w"), lambda s: F.when(F.length(s) % 2 == 0, F.array(F.length(s) * 2)).otherwise(F.array().cast("array<int>")))
    rows = line_words(t).select(F.explode(F.flatten(even)).alias("doubled"))
    return rows.groupBy(F.col("doubled").cast("bigint").alias("doubled")).agg(F.count(F.lit(1)).alias("n"))


@query("range_expand", "select p_partkey, unnest(generate_series(p_size::bigint, p_size + 2)) as v from part union all select p_partkey, unnest(generate_series(100::bigint, 99 + p_size)) from part")
def range_expand(t):
    size = c("p_size").cast("bigint")
    ranges = F.array(F.struct(size.alias("lo"), (size + 2).alias("hi")), F.struct(F.lit(100).cast("bigint").alias("lo"), (size + 99).alias("hi")))
    return t.part.select("p_partkey", F.explode(F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"])))).alias("v"))


@query("array_splice", "with" + LINES + """
    select doc_id, line_no, array_to_string(list_concat(list_concat(w[1:1], ['NEW', 'ROW']), w[4:]), ' ') as spliced,
           array_to_string(list_concat(w[1:len(w)-1], ['END']), ' ') as replaced, array_to_string(list_concat(['FIRST'], w[2:]), ' ') as front from w""")
def array_splice(t):
    w = c("w")
    return line_words(t).select(
        "doc_id", "line_no", F.array_join(x.splice(w, 1, 2, F.lit("NEW"), F.lit("ROW")), " ").alias("spliced"),
        F.array_join(x.with_at(w, -1, F.lit("END")), " ").alias("replaced"),
        F.array_join(F.array_insert(x.splice(w, 0, 1), 1, F.lit("FIRST")), " ").alias("front"))


@query("array_search", "with" + LINES + """
    select doc_id, line_no, list_contains(w, 'the') as has, list_contains(w[4:], 'the') as later, coalesce(list_position(w, 'the'), 0) - 1 as pos from w""")
def array_search(t):
    w, the = c("w"), F.lit("the")
    return line_words(t).select("doc_id", "line_no", F.array_contains(w, the).alias("has"), x.contains_from(w, the, 3).alias("later"),
                                x.index_of(w, the).alias("pos"))


@query("array_zip", """
    select vec_id, round(list_sum(list_transform(list_zip(embedding[1:60], embedding[5:64]), lambda p: p[1]::double * p[2]::double)), 4) + 0.0 as lagged,
           round(embedding[label + 1]::double, 4) + 0.0 as at_label from embeddings""")
def array_zip(t):
    e = c("embedding")
    pairs = x.zip_short(e, F.slice(e, F.lit(5), F.size(e)), lambda a, b: a.cast("double") * b.cast("double"))
    by_index = F.map_from_arrays(F.sequence(F.lit(0), F.size(e) - 1), e)
    return t.embeddings.select("vec_id", (F.round(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p), 4) + 0.0).alias("lagged"),
                               (F.round(F.try_element_at(by_index, c("label")).cast("double"), 4) + 0.0).alias("at_label"))


@query("transpose", """
    with l as (select vec_id, generate_subscripts(embedding, 1) - 1 as col, unnest(embedding) as cell from embeddings)
    select cast(col as int) as col, part_no, string_agg(cast(cast(round(cell::double * 10000) as bigint) as varchar), ',' order by vec_id) as items from """
       + numbered_sql("l", "col", "vec_id") + " group by col, part_no")
def transpose(t):
    got = x.transpose(t.embeddings, "vec_id", "embedding")
    scaled = F.transform("items", lambda v: F.round(v.cast("double") * 10000).cast("bigint").cast("string"))
    return got.select("col", "part_no", F.array_join(scaled, ",").alias("items"))


@query("map_transform", """
    select r_name, part_no, coalesce(string_agg(lower(n_name) || '=' || (n_nationkey * 2), ',' order by lower(n_name)) filter (where n_nationkey > 3), '') as doubled from """
       + numbered_sql("nation join region on n_regionkey = r_regionkey", "r_name", "n_name") + " group by r_name, part_no")
def map_transform(t):
    rows = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    maps = collect_ordered(rows, ["r_name"], ["n_name"], F.struct("n_name", "n_nationkey"))
    m = F.map_filter(F.map_from_entries("items"), lambda k, v: v > 3)
    m = F.transform_keys(F.transform_values(m, lambda k, v: v * 2), lambda k, v: F.lower(k))
    return maps.select("r_name", "part_no", x.map_text(m).alias("doubled"))


@query("map_lookup", """
    select event_id, cast(json_extract_string(props, '$.k') as int) as k, cast(json_extract_string(props, '$.none') as int) as missing,
           len(json_keys(props))::int as size, array_to_string(json_keys(props), ',') as keys, list_contains(json_keys(props), 'k') as has from events""")
def map_lookup(t):
    m = F.from_json("props", "map<string,int>")
    return t.events.select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.try_element_at(m, F.lit("none")).alias("missing"),
                           F.size(m).alias("size"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"),
                           F.map_contains_key(m, "k").alias("has"))


@query("head_tail", "with" + LINES + """
    select doc_id, line_no, w[1] as head, len(w) - 1 as rest, array_to_string(w[2:], ' ') as tail from w""")
def head_tail(t):
    w = c("w")
    return line_words(t).select("doc_id", "line_no", F.try_element_at(w, F.lit(1)).alias("head"), (F.size(w) - 1).cast("bigint").alias("rest"),
                                F.array_join(x.tail(w), " ").alias("tail"))
