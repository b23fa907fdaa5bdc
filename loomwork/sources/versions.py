"""Partitioned tables whose change sets become visible all at once.

The rows of a partition lie in a folder of their own. A version of the table is a
manifest: one line per partition with the folder that holds it. A change set reads the
partitions that it touches, writes them to new folders, and appends the next manifest,
which is a single file and so is there as a whole or not at all. Partitions that are not
touched keep their folders and files; a write that fails leaves the version before.
Nothing is edited in place, so a reader of an older version goes on undisturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, writer string, part string, folder string"


class ChangedMeanwhile(RuntimeError):
    """Another writer has made the next version first; read it and try again."""


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all manifests, with the time (``at``) and writer that say who came first."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("*", F.struct("_metadata.file_modification_time", "writer").alias("at"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST + ", at struct<file_modification_time: timestamp, writer: string>")


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version; 0 for a table that is not there."""
    return _manifests(spark, path).agg(F.max("version")).first()[0] or 0


def folders(spark: SparkSession, path: str, version: int | None = None) -> dict[str | None, str]:
    """Partition value (as text) -> folder. Of writers that raced for a version the one whose manifest came first has it."""
    rows = _manifests(spark, path).where(F.col("version") == (latest(spark, path) if version is None else version)).collect()  # a line per partition
    first = min((tuple(r["at"]) for r in rows), default=None)
    # a version without partitions has one line without a folder
    return {r["part"]: r["folder"] for r in rows if tuple(r["at"]) == first and r["folder"] is not None}


def read_version(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version (the last one by default); an empty table where it has no partition."""
    found = folders(spark, path, version)
    return spark.read.schema(schema).parquet(*found.values()) if found else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, path: str, version: int, parts: dict[str | None, str]) -> int:
    writer = uuid.uuid4().hex
    lines = [(version, writer, p, f) for p, f in parts.items()] or [(version, writer, None, None)]
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    won = _manifests(spark, path).where(F.col("version") == version).agg(F.min("at")).first()[0]
    if won["writer"] != writer:
        raise ChangedMeanwhile(f"version {version} of {path} was made by another writer")
    return version


def _written(df: DataFrame, path: str, column: str, touched: Sequence[str | None]) -> dict[str | None, str]:
    """Write rows to one new folder per partition; partition -> folder for those of ``touched`` that have rows."""
    base = f"{path}/data/{uuid.uuid4().hex}"
    # the column itself stays in the files; a copy, as text with a mark for null, names the folders
    name = F.when(F.col(column).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(column).cast("string")))
    df.withColumn("__part", F.sha2(name, 256)).write.partitionBy("__part").parquet(base)
    there = {r[0] for r in df.sparkSession.read.parquet(base).select("__part").distinct().collect()} if touched else set()
    spark = df.sparkSession
    digest = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in touched], "part string")
              .select("part", F.sha2(F.when(F.col("part").isNull(), "null").otherwise(F.concat(F.lit("="), "part")), 256)).collect()}
    return {t: f"{base}/__part={digest[t]}" for t in touched if digest[t] in there}


def create_partitioned(df: DataFrame, path: str, column: str) -> int:
    """Make version 1 (or replace all partitions in the next version), one folder per value of ``column``; null is a value."""
    spark = df.sparkSession
    version = latest(spark, path) + 1
    touched = [r[0] for r in df.select(F.col(column).cast("string").alias("p")).distinct().collect()]
    return _commit(spark, path, version, _written(df, path, column, touched))


def change_partitioned(changes: DataFrame, path: str, column: str, keys: Sequence[str], deleted: str | None = None) -> int:
    """Apply a change set and return the new version: rows with equal ``keys`` (nulls are equal) are replaced, others inserted, and those marked ``deleted`` go.

    ``column`` is one of the keys, so that a change touches only the partition that it names. A key may be changed once (else the version is not made). Only touched
    partitions are read and written; if nothing changes there is no new version. Raises ``ChangedMeanwhile`` if another writer came first: the change is not made then.
    """
    if column not in keys:
        raise ValueError("the partition column must be one of the keys")
    spark = changes.sparkSession
    now = latest(spark, path)
    if not now:
        raise ValueError(f"no table at {path}")
    if changes.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("a key is changed twice")
    touched = [r[0] for r in changes.select(F.col(column).cast("string").alias("p")).distinct().collect()]
    if not touched:
        return now
    parts = folders(spark, path, now)
    columns = [c for c in changes.columns if c != deleted]
    schema = changes.select(columns).schema
    old = [parts[t] for t in touched if t in parts]
    stays = changes.select(columns) if deleted is None else changes.where(~F.coalesce(F.col(deleted), F.lit(False))).select(columns)
    if old:
        rows, side = spark.read.schema(schema).parquet(*old), changes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        match = F.lit(True)
        for i, k in enumerate(keys):
            match = match & rows[k].eqNullSafe(side[f"__k{i}"])
        stays = rows.join(side, match, "left_anti").unionByName(stays)
    new = _written(stays, path, column, touched)
    return _commit(spark, path, now + 1, {**{p: f for p, f in parts.items() if p not in touched}, **new})
