"""Streams from a folder of files, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.hot import neighbours
from loomwork.session import fresh_path


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files: str = "*.parquet", bytes_per_batch: int = 256 << 20) -> DataFrame:
    """New Parquet files of a folder as a stream.

    A micro-batch holds files of a bounded size together (but always a whole file), and
    with them a bounded number of rows of any key, which is what the keyed processors sort.
    """
    return (spark.readStream.schema(like.schema).option("pathGlobFilter", files)
            .option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(folder))


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Write the stream to a new table with exactly-once files, wait for the end, give the table."""
    spark = stream.sparkSession
    target, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state)
     .trigger(availableNow=True).start(target).awaitTermination())
    return spark.read.schema(stream.schema).parquet(target)


def debounced(df: DataFrame, key: str, ts: str, ident: str, gap_us: int) -> DataFrame:
    """Rows after which the key is quiet for at least ``gap_us``: the values that settle."""
    def make(w):
        return {"__wait": F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))}
    rows = neighbours(df, [key], [ts, ident], make, ahead=1)
    return rows.where(F.col("__wait").isNull() | (F.col("__wait") >= gap_us)).drop("__wait")


def debounced_stream(stream: DataFrame, key: str, ts: str, order: list[str], value: str, gap: str, delay: str) -> DataFrame:
    """The same on a stream: the last value of every session. ``delay`` is how late a row may come.

    A session is given out once the watermark has passed its end, so those near
    the end of the stream wait for more input.
    """
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    last = rows.groupBy(key, F.session_window("__ts", gap)).agg(F.max_by(F.struct(ts, value), F.struct(*order)).alias("__l"))
    return last.select(key, F.col(f"__l.{ts}").alias("settled_at"), F.col(f"__l.{value}").alias(value))


def within_quota(df: DataFrame, key: str, ts: str, order: list[str], window: str, quota: int) -> DataFrame:
    """The first ``quota`` rows per key and tumbling window.

    The rank limit is applied before the shuffle too, so a busy window sends
    ``quota`` rows per task.
    """
    from pyspark.sql import Window
    rows = df.withColumn("__w", F.window(F.col(ts).cast("timestamp"), window)["start"])
    rank = F.row_number().over(Window.partitionBy(key, "__w").orderBy(*order))
    return rows.withColumn("__r", rank).where(F.col("__r") <= quota).drop("__r", "__w")


def first_success(df: DataFrame, key: str, healthy: Column, latency: Column, result: Column, default: str) -> DataFrame:
    """Per key the result of the fastest healthy row; ``default`` where none is healthy."""
    fastest = F.min_by(F.when(healthy, result), F.when(healthy, latency))
    return df.groupBy(key).agg(F.coalesce(fastest, F.lit(default)).alias("result"))
