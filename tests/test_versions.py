"""Change sets on partitioned tables: whole or not at all, and only what they touch is written."""

import pytest
from pyspark.sql import functions as F

from loomwork.sources import versions as v

COLUMNS = "day string, id long, amount double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(spark, path, version=None):
    """Partition -> the names of its files."""
    return {p: sorted(r[0] for r in spark.read.parquet(f).select(F.input_file_name()).distinct().collect()) for p, f in v.folders(spark, path, version).items()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    base = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, 3.0), (None, 4, 4.0), ("c/d e=f", 5, 5.0), ("null", 6, 6.0)]
    assert v.create_partitioned(spark.createDataFrame(base, COLUMNS), path, "day") == 1
    return path, base


def test_a_change_writes_only_what_it_touches(spark, table):
    path, base = table
    schema = spark.createDataFrame([], COLUMNS).schema
    assert rows(v.read_version(spark, path, schema)) == sorted(base, key=repr)
    before = files(spark, path)
    changes = [("a", 1, 10.0, False), ("a", 2, None, True), ("new", 9, 9.0, None), (None, 4, 40.0, False), ("c/d e=f", 5, None, True), ("a", 77, None, True)]
    assert v.change_partitioned(spark.createDataFrame(changes, COLUMNS + ", gone boolean"), path, "day", ["day", "id"], "gone") == 2
    assert rows(v.read_version(spark, path, schema)) == sorted([("a", 1, 10.0), ("b", 3, 3.0), (None, 4, 40.0), ("null", 6, 6.0), ("new", 9, 9.0)], key=repr)
    after = files(spark, path)
    assert after["b"] == before["b"] and after["null"] == before["null"] and after["a"] != before["a"] and "c/d e=f" not in after
    # the old version is still there
    assert rows(v.read_version(spark, path, schema, 1)) == sorted(base, key=repr) and files(spark, path, 1) == before
    assert v.change_partitioned(spark.createDataFrame([], COLUMNS), path, "day", ["day", "id"]) == 2


def test_a_failed_write_leaves_the_old_version(spark, table):
    path, base = table
    bad = spark.createDataFrame([("a", 1, 10.0), ("b", 3, 0.0)], COLUMNS).withColumn("amount", F.when(F.col("day") == "b", F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="no"):
        v.change_partitioned(bad, path, "day", ["day", "id"])
    assert v.latest(spark, path) == 1 and rows(v.read_version(spark, path, bad.schema)) == sorted(base, key=repr)
    twice = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], COLUMNS)
    for change, keys in ((twice, ["day", "id"]), (twice, ["id"])):
        with pytest.raises(ValueError):
            v.change_partitioned(change, path, "day", keys)
    with pytest.raises(ValueError):
        v.change_partitioned(twice.limit(1), path + "-none", "day", ["day", "id"])


def test_of_two_writers_one_wins(spark, table, monkeypatch):
    path, base = table
    change = spark.createDataFrame([("a", 1, 10.0)], COLUMNS)
    other = spark.createDataFrame([("b", 3, 30.0)], COLUMNS)
    real, seen = v._written, []

    def late(df, *how):
        out = real(df, *how)
        if not seen:  # another writer commits while this one is writing
            seen.append(1)
            v._commit(spark, path, 2, {**v.folders(spark, path, 1), **real(other, path, "day", ["b"])})
        return out

    monkeypatch.setattr(v, "_written", late)
    names = iter(["b" * 32, "a" * 32, "c" * 32, "d" * 32, "z" * 32])
    monkeypatch.setattr(v.uuid, "uuid4", lambda: type("U", (), {"hex": next(names)})())
    with pytest.raises(v.ChangedMeanwhile):
        v.change_partitioned(change, path, "day", ["day", "id"])
    got = rows(v.read_version(spark, path, change.schema))
    assert ("b", 3, 30.0) in got and ("a", 1, 1.0) in got and len(got) == len(base)


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    none = spark.createDataFrame([], COLUMNS)
    assert v.latest(spark, path) == 0 and v.create_partitioned(none, path, "day") == 1
    assert v.read_version(spark, path, none.schema).count() == 0
    assert v.change_partitioned(spark.createDataFrame([("x", 1, 1.0)], COLUMNS), path, "day", ["day", "id"]) == 2
    assert rows(v.read_version(spark, path, none.schema)) == [("x", 1, 1.0)]
