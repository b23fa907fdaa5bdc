"""Line-oriented text: scan and sink, logs, and section/key=value files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.hot import fill_forward

LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").option("lineSep", "\n").text(path)


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no, line)``; lines count from 0 and blank ones stay."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def at_least(log: DataFrame, level: str) -> DataFrame:
    """Log rows of this severity or above."""
    return log.where(F.col("level").isin(LEVELS[LEVELS.index(level):]))


def parse_sections(lines: DataFrame, file: str) -> DataFrame:
    """Lines ``(file, line_no, line)`` to ``(file, section, key, value)``.

    A header ``[name]`` holds until the next one; lines before any header are
    in section ``default``. A header given again empties its section; of a key
    given twice in a section the later line wins.
    """
    rows = lines.select(file, "line_no", F.trim("line").alias("line"))
    is_header = F.col("line").startswith("[") & F.col("line").endswith("]")
    name = F.expr("substring(line, 2, greatest(length(line) - 2, 0))")
    rows = rows.withColumn("head", F.when(is_header, F.struct(name.alias("section"), F.col("line_no").alias("at"))))
    renewed = (rows.where("head is not null").groupBy(file, F.col("head.section").alias("section"))
               .agg(F.max("line_no").alias("renewed")))
    rows = fill_forward(rows.withColumn("is_header", is_header), [file], ["line_no"], "head")
    pair = F.split("line", "=", 2)
    entries = (rows.where(~F.col("is_header") & F.col("line").contains("="))
               .select(file, "line_no", F.coalesce("head.section", F.lit("default")).alias("section"),
                       F.coalesce("head.at", F.lit(-1)).alias("at"),
                       F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value")))
    entries = entries.join(renewed, [file, "section"], "left").where("renewed is null or at = renewed")
    return entries.groupBy(file, "section", "key").agg(F.max_by("value", "line_no").alias("value"))
