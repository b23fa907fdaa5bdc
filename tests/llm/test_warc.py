import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from llm.conftest import EDGES, same
from loomwork.llm import warc
from loomwork.session import fresh_path

PAGES = [(i, None if i % 5 == 0 else f"http://host/{i}?q=a b\n", t) for i, (_, t) in enumerate(EDGES)] + [(50 + k, "u", "<html>" + "x" * (37 * k) + "\r\n\r\n") for k in range(12)] + [
    (70, "u", "shared"), (72, "u", "shared"), (71, "u", "shared"), (72, "u", "shared"), (None, "u", "shared"), (None, "u", "alone"), (80, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id long, url string, html string, block string, last string").repartition(3)


def brute(rows):
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(last.get(t or "", (False, 0)), (i is not None, i or 0))
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        known, top = last[t or ""]
        response = not known or i == top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top))
    return out


def test_round_trip(spark):
    for segment, chunk, file_records in ((1 << 16, 1 << 13, 1000), (64, 10, 7)):
        path = fresh_path(spark, "warc")
        warc.write_archives(frame(spark, PAGES), path, segment=segment, chunk=chunk, file_records=file_records)
        assert same(warc.read_pages(spark, path).collect(), brute(PAGES))
        records = warc.read_records(spark, path)
        if segment == 64:
            assert records.where("type = 'continuation'").count() > 100
            assert records.groupBy("name").count().where("count > 1").count() == 0
        texts = {r.page_id: bytes(r.payload).decode() for r in warc.read_responses(records).where("page_id is not null").collect()}
        assert texts[6] == PAGES[6][2] and texts[80] == PAGES[-1][2] and texts[11] == ""


def test_an_absent_or_false_segment_is_an_error(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(frame(spark, [(1, "u", "y" * 500)]), path, segment=64)
    records = warc.read_records(spark, path)
    assert warc.read_responses(records).count() == 1
    for broken in (records.where("coalesce(segment, 0) <> 3"), records.withColumn("total", F.col("total") + 1), records.withColumn("digest", F.lit("A" * 32))):
        with pytest.raises(Exception, match="segments|digest"):
            warc.read_responses(broken).collect()


def test_chunked_framing():
    for size in (1, 7, 1000):
        for body in (b"", b"a", b"\r\n" * 20, bytes(range(256)) * 3):
            assert warc.unchunked(warc.chunked(body, size)) == body
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(b"3;note=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def test_an_empty_table(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(frame(spark, []), path)
    assert warc.read_pages(spark, path).count() == 0
