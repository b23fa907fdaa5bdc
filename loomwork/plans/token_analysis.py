"""Token analysis: tokens rolled up, matched with the repository and the address list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.aggregates import rollup_text


def _matched(tokens: DataFrame, repository: DataFrame, addresses: DataFrame, source: str) -> DataFrame:
    b = repository.where(F.col("cir_type") == source).select("cir_key", "tr_sub_premise_key").alias("b")
    c = addresses.select(F.col("nad_key").alias("c_nad_key")).alias("c")
    joined = (tokens.join(b, F.col("tokenid") == F.col("cir_key"), "left")
              .join(c, F.col("tr_sub_premise_key") == F.col("c_nad_key"), "left"))
    return joined.withColumn("in_baabp", F.when(F.col("c_nad_key").isNotNull(), "Y").otherwise("N")).drop("c_nad_key")


def _tokens(base: DataFrame, *more) -> DataFrame:
    """One row per token. Aggregated before any join; the lists are bounded per row."""
    rolled = rollup_text(base, ["tokenid"], {"nad_key": True, "status": False, "createtype": True}, more)
    return rolled.withColumnsRenamed({"nad_key": "new_key", "n_rows": "cnt"})


def token_analysis(base: DataFrame, repository: DataFrame, addresses: DataFrame, kind: str = "UPRN",
                   source: str = "NGC") -> DataFrame:
    """Tokens of any create type but ``kind``. ``base``: tokenid, nad_key, status, createtype, uprn."""
    return _matched(_tokens(base.where(F.col("createtype") != kind)), repository, addresses, source)


def token_analysis_uprn(base: DataFrame, repository: DataFrame, addresses: DataFrame, kind: str = "UPRN",
                   source: str = "NGC") -> DataFrame:
    """Tokens of create type ``kind``, with the largest uprn and the address found by it."""
    tokens = _tokens(base.where(F.col("createtype") == kind), F.max("uprn").alias("uprn"))
    second = addresses.select(F.col("uprn").alias("d_uprn"), F.col("nad_key").alias("baabp_key"))
    return (_matched(tokens, repository, addresses, source)
            .join(second, F.col("uprn") == F.col("d_uprn"), "left").drop("d_uprn"))
