"""Benchmark items inside documents, by size-partitioned MinHash containment, with DataFrame functions only.

A document may be a thousand times longer than an item, so the similarity of the two
sets tells nothing and bands of whole-document signatures would miss the item. What
matters is containment: the chance that an item's minimum hash is among a document's
hashes is exactly the share of the item that the document contains. Items are
partitioned by size; a partition's sketch is the k smallest hashes of an item, with k
one more than the shingles that any item of the partition may lack at the threshold.
So a document that contains an item at the threshold holds at least one hash of its
sketch: no item is missed. Pairs found are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import free_names, written
from loomwork.llm.line_dedup import row_keys

#: Item shingles up to which sketches and items are broadcast (some 40 bytes each); beyond it Spark joins them as it sees fit.
BROADCAST_SHINGLES = 1 << 18


def words_of(text: Column) -> Column:
    """The runs of letters and digits of a text, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _starts(words: str, size: int) -> Column:
    """Where shingles start; a text of fewer words is one shingle, an empty one has none."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))))


def shingle_hashes(words: str, size: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))


def shingle_texts(words: str, size: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, size), lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def item_sketches(items: DataFrame, percent: int, size: int, item_id: str, text_col: str) -> DataFrame:
    """``item, shingles, n, need, sketch`` for each item with words."""
    out = items.select(F.col(item_id).alias("item"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    out = out.withColumns({"shingles": shingle_texts("words", size), "hashes": shingle_hashes("words", size)}).where(F.size("shingles") > 0)
    out = out.withColumn("n", F.size("shingles"))
    # partitions by size: 1, 2-3, 4-7, ... shingles
    most = (F.pow(F.lit(2), F.length(F.bin("n"))) - 1).cast("int")
    k = F.floor(most * (100 - percent) / 100).cast("int") + 1
    return out.select("item", "shingles", "n", F.ceil(F.col("n") * percent / 100).cast("int").alias("need"),
                      F.slice(F.array_sort("hashes"), F.lit(1), F.least(k, F.size("hashes"))).alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id, k1, k2, item, shared, n``: each row of ``docs`` that contains at least ``percent`` % of an item's distinct shingles of ``size`` words.

    Words are runs of letters and digits in lower case. Items and texts of fewer words are one shingle; those without words contain and are found in nothing, as are
    null texts. Repeated rows and items come back as often as they are there, null ids as null. Empty tables give an empty result; further columns are ignored.
    """
    sketches = written(item_sketches(items, percent, size, item_id, item_text).select(F.monotonically_increasing_id().alias("no"), "*"), "sketches")
    total = sketches.agg(F.sum("n")).first()[0] or 0
    few = (lambda df: F.broadcast(df)) if total <= BROADCAST_SHINGLES else (lambda df: df)
    probes = sketches.select("no", "need", F.explode("sketch").alias("hash"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", *row_keys(F.col("id"), F.col("text")))
    hashes = rows.select("k1", "k2", words_of(F.col("text")).alias("words")).select("k1", "k2", shingle_hashes("words", size).alias("hashes"))
    hashes = hashes.select("k1", "k2", F.coalesce(F.size("hashes"), F.lit(0)).alias("size"), F.explode_outer("hashes").alias("hash"))
    # (explode or a nullable size would make Spark add a filter, push it below the step that makes the words and split the text again for each word)
    # a document smaller than what an item needs cannot contain it
    found = hashes.join(few(probes), "hash").where("size >= need").groupBy("k1", "k2").agg(F.collect_set("no").alias("nos"))
    found = written(found, "candidates")  # a set is no longer than its document
    texts = rows.join(found, ["k1", "k2"]).select("id", "k1", "k2", "nos", words_of(F.col("text")).alias("words"))
    texts = texts.select("id", "k1", "k2", shingle_texts("words", size).alias("own"), F.explode("nos").alias("no"))
    pairs = texts.join(few(sketches.select("no", "item", "shingles", "n", "need")), "no")
    pairs = pairs.withColumn("shared", F.coalesce(F.size(F.array_intersect("shingles", "own")), F.lit(0)))
    return pairs.where("shared >= need").select("id", "k1", "k2", "item", F.col("shared").cast("long"), F.col("n").cast("long"))


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    a, b = free_names(docs, "__k1", "__k2")
    gone = contained_items(docs, items, id_col=id_col, text_col=text_col, **how).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = row_keys(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumns({a: k1, b: k2}).join(gone, [a, b], "left_anti").drop(a, b)
