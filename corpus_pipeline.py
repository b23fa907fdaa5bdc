"""The stages that turn ``documents`` into training text: judged, without shared lines, copies and benchmark items, and encoded.

Each stage takes (spark, docs, sf_dir), works on every row it gets, and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, line_dedup, piece_codec, quality_fm, simhash
from loomwork.llm.common import free_names, ready, table, written

#: Documents with a lower score go.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``LEAST_SCORE``; the model learns from the labels of ``sf_dir`` and the given texts."""
    ready(spark)
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    score, = free_names(docs, "score")
    return quality_fm.scored(docs, model, name=score).where(F.col(score) >= LEAST_SCORE).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand in three or more documents, but for the document with the largest id; ``n_chars`` follows the text."""
    ready(spark)
    n_lines, n_dropped, kept = free_names(docs, "n_lines", "n_dropped", "kept")
    out = line_dedup.drop_shared_lines(docs, min_chars=20, min_docs=3, names=(n_lines, n_dropped, kept))
    # a null text stays null
    text = F.when(F.col("text").isNotNull(), F.col(kept))
    out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    ready(spark)
    return simhash.keep_one(docs, words=4, bits=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"), percent=80, size=5)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document with an end id, and the text that they decode to."""
    ready(spark)
    model = piece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    out = piece_codec.encode_decode(docs, model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", copies), ("benchmark decontamination", benchmark), ("sentencepiece", encoded)]

#: SQL can express neither the trained classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on what the one before has kept, written and read again in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
