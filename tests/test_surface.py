"""User functions on long texts."""

import pandas as pd
from pyspark.sql import functions as F

from loomwork.catalog.registry import QUERIES
from loomwork.catalog import surface  # noqa: F401 (registers the query)


def test_texts_reach_python_in_small_batches(spark, tmp_path):
    texts = [(i, "é" * 100_000 if i % 4 else None) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["pandas_udf_map"](spark, str(tmp_path))
    assert {r.doc_id: r.plain for r in out.collect()} == {i: t and "e" * 100_000 for i, t in texts}

    @F.pandas_udf("long")
    def in_batch(text: pd.Series) -> pd.Series:
        return pd.Series([len(text)] * len(text))

    # under the query's settings: 12 MB of texts are several batches, not one
    sizes = spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1).select(in_batch("text").alias("n")).collect()
    assert max(r.n for r in sizes) <= 15
