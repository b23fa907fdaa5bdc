"""The registered queries of the operators in this subpackage, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import (centroids, decontaminate, grid_order, line_dedup, outliers, piece_codec, quality_fm, quote_links, simhash, suffix_dedup, token_counts,
                          vector_codes, warc)
from loomwork.llm.common import sha256_hex, table
from loomwork.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def digest_of_ids(ids):
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)


@query()
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = piece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = piece_codec.encode_decode(table(spark, folder, "documents"), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest_of_ids(F.col("ids")).alias("ids_sha256"),
                        sha256_hex(F.col("decoded")).alias("decoded_sha256"))


@query()
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = token_counts.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    docs, cache = table(spark, folder, "documents"), fresh_path(spark, "token-cache")
    # a first run meets the texts of one source; the second joins all texts to its counts and encodes the others
    token_counts.add_misses(docs.where("source = 'src1'"), tokenizer, cache)
    counts = token_counts.count_tokens(docs, tokenizer, cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=4, bits=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


LINE_DEDUP_SQL = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, row_no, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM split),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT row_no) >= 3),
judged AS (SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.holder AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id, row_no
"""


@query(LINE_DEDUP_SQL)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(table(spark, folder, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), sha256_hex(F.col("__kept")).alias("kept_sha256"))


@query()
def op1_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_fm.train(docs, table(spark, folder, "labels"), metadata=("n_chars",))
    out = quality_fm.scored(docs.select("doc_id", "text", "n_chars"), model)
    return out.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))


@query()
def op9_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judged(table(spark, folder, "documents")).select("doc_id", "n_words", *outliers.BASE, "base_failed", "kept", "distance")


DECONTAMINATE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item_no, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT row_no, doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
its AS (SELECT DISTINCT item_no, item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_no, count(*) AS n FROM its GROUP BY item_no)
SELECT doc_id, item_id, count(*) AS shared, any_value(n.n) AS n_shingles
FROM its JOIN ds USING (s) JOIN n USING (item_no) GROUP BY row_no, doc_id, item_no, item_id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""


@query(DECONTAMINATE_SQL)
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=80, size=5)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "shared", F.col("n").alias("n_shingles"))


QUOTE_LINKS_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS body,
    nullif(trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')), '') AS h FROM conversations),
c AS (SELECT a.*, b.h AS h1, CASE WHEN b.turn IS NOT NULL THEN e.h END AS h2 FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
      LEFT JOIN t e ON e.conv_id = a.conv_id AND e.turn = a.turn - 2),
both_keys AS (SELECT h AS x, coalesce(h1, '-') AS y, min((conv_id, turn)) AS id FROM c WHERE h IS NOT NULL GROUP BY ALL),
own AS (SELECT h AS x, min((conv_id, turn)) AS id FROM c WHERE h IS NOT NULL GROUP BY ALL),
l AS (SELECT c.conv_id, c.turn, c.role, c.body, coalesce(CASE WHEN p.id < (c.conv_id, c.turn) THEN p.id END, CASE WHEN o.id < (c.conv_id, c.turn) THEN o.id END) AS parent
      FROM c LEFT JOIN both_keys p ON p.x = c.h1 AND p.y = coalesce(c.h2, '-') LEFT JOIN own o ON o.x = c.h1),
r AS (SELECT conv_id, turn, (conv_id, turn) AS root, 0 AS depth FROM l WHERE parent IS NULL
      UNION ALL SELECT l.conv_id, l.turn, r.root, r.depth + 1 FROM l JOIN r ON l.parent = (r.conv_id, r.turn))
SELECT l.conv_id, l.turn, l.role, l.body AS text, l.parent[1] AS parent_conv, l.parent[2] AS parent_turn, r.root[1] AS root_conv, r.root[2] AS root_turn, CAST(r.depth AS BIGINT) AS depth
FROM l JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn
"""


@query(QUOTE_LINKS_SQL)
def op8_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    messages = quote_links.quoting_messages(table(spark, folder, "conversations"), levels=3)
    found = quote_links.linked(messages, passed=("conv_id", "turn", "role"))
    root = lambda c: F.when(F.col("id").isNull(), F.col(c)).otherwise(F.col(f"root.{c}"))
    return found.select(
        "conv_id", "turn", "role", "text", F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        root("conv_id").alias("root_conv"), root("turn").alias("root_turn"), "depth")


# base32 has no function there: five hex digits of the SHA-1 are four characters
WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
last AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST((k // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest
FROM p JOIN last USING (h)
"""


@query(WARC_SQL)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    path = fresh_path(spark, "warc")
    warc.write_archives(pages, path)
    return warc.read_pages(spark, path)


@query()
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, folder, "documents"), length=200)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _whole_vectors(scale: int) -> str:
    """A table ``k`` of the vectors that count, as whole numbers, numbered by ``rid``."""
    return f"""k AS (SELECT row_number() OVER () AS rid, *, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)"""


# floor of a quotient of whole numbers: the rest is taken off first
_FLOOR = "CAST((s - (((s % n) + n) % n)) AS BIGINT) // n"


def _centroid_steps(rounds: int) -> str:
    out = []
    for r in range(rounds + 1):
        out.append(f"""a{r} AS (SELECT rid, min((d, c))[2] AS c, min(d) AS d FROM (
      SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c{r}.v[i]) * (k.v[i] - c{r}.v[i]))) AS d FROM k, c{r}) GROUP BY rid)""")
        if r < rounds:
            out.append(f"""m{r} AS (SELECT c, list({_FLOOR} ORDER BY i) AS v FROM (
      SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN k USING (rid), range(1, 65) AS t(i) GROUP BY c, i) GROUP BY c),
    c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)""")
    return ",\n    ".join(out)


CENTROIDS_SQL = f"""
WITH {_whole_vectors(64)},
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM k QUALIFY c < 16),
    {_centroid_steps(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN k USING (rid) JOIN c3 USING (c)
"""


@query(CENTROIDS_SQL)
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    first = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found, final = centroids.clustered(table(spark, folder, "embeddings"), k=16, rounds=3, scale=64, dim=64, first=first)
    return centroids.with_totals(found, final).withColumnRenamed("id", "vec_id")


GRID_ORDER_SQL = """
WITH RECURSIVE k AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
    g AS (SELECT *, sqrt(list_dot_product(v, v)) AS n, len(v) AS z FROM k WHERE v IS NOT NULL),
    l AS (SELECT a.rid AS x, b.rid AS y FROM g a JOIN g b ON a.z = b.z AND a.rid <> b.rid WHERE CASE WHEN a.z = b.z THEN list_dot_product(a.v, b.v) / (a.n * b.n) END >= 0.95),
    reach AS (SELECT rid, rid AS other FROM k UNION SELECT reach.rid, l.y FROM reach JOIN l ON reach.other = l.x),
    least AS (SELECT reach.rid, min(o.vec_id) AS component_id FROM reach JOIN k o ON o.rid = reach.other GROUP BY reach.rid),
    counts AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT k.vec_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links, component_id, coalesce(k.vec_id = component_id, false) AS kept
FROM k JOIN least ON k.rid = least.rid LEFT JOIN counts ON counts.x = k.rid
"""


@query(GRID_ORDER_SQL)
def op12_grid_order(spark: SparkSession, folder: str) -> DataFrame:
    found = grid_order.near_vectors(table(spark, folder, "embeddings"), least=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _codebook_steps(rounds: int) -> str:
    out = []
    for r in range(rounds + 1):
        out.append(f"""d{r} AS (SELECT rid, p, e, list_sum(list_transform(range(1, 5), lambda i: (w.v[i] - b{r}.v[i]) * (w.v[i] - b{r}.v[i]))) AS d FROM w JOIN b{r} USING (p)),
    a{r} AS (SELECT rid, p, min((d, e))[2] AS e, min(d) AS d FROM d{r} GROUP BY rid, p)""")
        if r < rounds:
            out.append(f"""m{r} AS (SELECT p, e, list({_FLOOR} ORDER BY i) AS v FROM (
      SELECT p, e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN w USING (rid, p), range(1, 5) AS t(i) GROUP BY p, e, i) GROUP BY p, e),
    b{r + 1} AS (SELECT p, e, coalesce(m{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN m{r} USING (p, e))""")
    return ",\n    ".join(out)


VECTOR_CODES_SQL = f"""
WITH {_whole_vectors(256)},
    w AS (SELECT rid, p, v[4 * p + 1:4 * p + 4] AS v FROM k, range(0, 16) AS t(p)),
    s AS (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS e, rid FROM k QUALIFY e < 64),
    b0 AS (SELECT p, e, v FROM s JOIN w USING (rid)),
    {_codebook_steps(2)},
    c AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256((SELECT string_agg(array_to_string(v, ','), ',' ORDER BY p, e) FROM b2)) AS codebooks_sha256
FROM c JOIN k USING (rid)
"""


@query(VECTOR_CODES_SQL)
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    found, books = vector_codes.coded(table(spark, folder, "embeddings"), parts=16, entries=64, rounds=2, scale=256, dim=64)
    return vector_codes.with_totals(found, books).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
