"""Functions callable from SQL text: register once per session, then use by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="id int, data string", useArrow=True)
class PipeRows:
    """``pipe_rows('a|b')`` gives (1, a), (2, b)."""

    def eval(self, value: str):
        if value is not None:
            for i, data in enumerate(value.split("|"), start=1):
                yield i, data


def register(spark: SparkSession) -> SparkSession:
    spark.udtf.register("pipe_rows", PipeRows)
    return spark
