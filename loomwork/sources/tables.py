"""Tables: delimited text, tables made by a query, append-only tables, pages of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.hot import numbered
from loomwork.session import fresh_path


def text_schema(columns: Sequence[str]) -> T.StructType:
    """A declared shape in which every column is text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """A folder of delimited text as a table of text columns; no header, no quoting."""
    return (spark.read.schema(text_schema(columns))
            .option("sep", sep).option("quote", "").option("header", "false").csv(path))


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("sep", sep).option("quote", "").option("header", "false").mode("overwrite").csv(path)


def create_table(df: DataFrame, path: str) -> DataFrame:
    """Make a table from a query and return the table. Running it again replaces the table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder once and go on from the table.

    For a result that several later steps read: it is computed once, the plan
    stays short, and a lost executor re-reads files instead of redoing joins.
    """
    return create_table(df, fresh_path(df.sparkSession, name))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def audit_rows(df: DataFrame, owner: str, number: str, code: Column, text: Column, run_ts: str,
               prefix: str = "KSUDelay-") -> DataFrame:
    """One attribute row per input row: a numbered name, and ``time|code|text`` as value."""
    stamp = F.date_format(F.lit(run_ts).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    return df.select(F.col(owner).alias("owner"),
                     F.concat(F.lit(prefix), F.col(number).cast("string")).alias("name"),
                     F.concat(stamp, F.lit("|"), code, F.lit("|"), text).alias("value"))


def pages(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Add ``page`` (from 0) and ``row_in_page`` (from 1)."""
    at = numbered(df, [], order, "__rn")
    return (at.withColumn("page", F.floor((F.col("__rn") - 1) / size))
            .withColumn("row_in_page", (F.col("__rn") - 1) % size + 1).drop("__rn"))
