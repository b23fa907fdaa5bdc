"""What several operators need: the session, the shared folder, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import fresh_path, prepare

#: Bytes of text that one Python step works on at a time.
SLICE_BYTES = 2 << 20

#: The white space of all word rules here: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that these operators count on: Arrow batches of a few MB."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the files."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many further underscores in front as it takes to be no column of ``df`` in any case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes in ``column`` (one row may be longer)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(column)
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1 + col.offset)[col.offset:])
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            past = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, past + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    col = batch.column(column)
    return [b"" if v is None else v for v in col.cast(pa.binary()).to_pylist()]


def sha256_hex(col: Column) -> Column:
    """Lower-case hex of the SHA-256 of a text in UTF-8."""
    return F.sha2(F.encode(col, "UTF-8"), 256)
