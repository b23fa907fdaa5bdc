"""Writing pages to WARC archives, and reading archives with segmented and chunked records.

A payload that an earlier-numbered copy shares is written once: the largest id has the
response, the others are revisits. Large records are cut into segments; reading groups
the continuations by origin, orders them by segment number, verifies the total length
and takes off the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import slices, written

#: Bytes of a record's block in one segment, and of a chunk of its body.
SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
#: Records of a file: with segments this bounds its size.
FILE_RECORDS = 1000
END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        eol = framed.index(b"\r\n", at)
        size = int(framed[at:eol].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = framed[eol + 2: eol + 2 + size]
        if len(part) < size or framed[eol + 2 + size: eol + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = eol + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of a block with an HTTP response."""
    head, _, body = block.partition(END)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    named = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{named}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _records(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, segment: int, chunk: int) -> list[bytes]:
    """The records of one page, without the two line ends behind each."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    # what would break a header line is written as in URLs
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    own = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-ID", page_id)]
    digest = ("WARC-Payload-Digest", "sha1:" + digest32(payload))
    if revisit:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *own, digest, ("X-Refers-To-Page-ID", refers_to),
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END + chunked(payload, chunk)
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *own, digest, ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name),
                            ("WARC-Segment-Number", n), last], part))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Archives of one or more records for each row, gzipped, in the folder ``path``.

    Of rows with equal payloads those with the largest id are responses (repeated rows of that id all are), the others revisits of it. Null ids come before all
    others; a null html is an empty payload; a null URL leaves the field out. An empty table gives an empty folder. Further columns are ignored.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("hash", F.sha2("payload", 256))
    # small rows find the shared payloads; only those are joined back
    shared = rows.select("hash", "id").groupBy("hash").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("hash", "last")
    # (the hash itself is not carried: the payload is in the row)
    rows = rows.join(shared, "hash", "left").select("id", "url", "payload", "last")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            out = []
            for page, url, data, last in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "last"))):
                revisit = last is not None and page != last
                out += _records(page, url, data, last if revisit else None, revisit, segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # the text writer puts the bytes down as they are; two line ends close each record
    (rows.mapInArrow(work, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path))


class _Reader:
    """Records of an archive, one after the other, from gzipped or plain bytes."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.at, self.step, self.ahead = data, 0, step, bytearray()
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.gz is not None and self.gz.eof:  # the next member of the file
            rest = self.gz.unused_data
            if rest:
                self.at -= len(rest)
                self.gz = zlib.decompressobj(31)
        if self.at >= len(self.data):
            return False
        part = self.data[self.at: self.at + self.step]
        self.at += len(part)
        self.ahead += self.gz.decompress(part) if self.gz is not None else part
        return True

    def take(self, n: int) -> bytes:
        while len(self.ahead) < n and self.more():
            pass
        if len(self.ahead) < n:
            raise ValueError("a record is cut short")
        out = bytes(self.ahead[:n])
        del self.ahead[:n]
        return out

    def __iter__(self):
        while True:
            while (end := self.ahead.find(END)) < 0 and self.more():
                pass
            if end < 0:
                if self.ahead.strip():
                    raise ValueError("bytes behind the last record")
                return
            head = self.take(end + 4).decode()
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:] if line)}
            block = self.take(int(fields["content-length"]))
            if self.take(4) != END:
                raise ValueError("a record does not end where its length says")
            yield fields, block


RECORD = "type string, name string, page_id long, url string, digest string, refers_to long, origin string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, segments as they are. A file is read as a whole; files of ``write_archives`` are bounded."""

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("type", pa.string()), ("name", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()),
                            ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for f, block in _Reader(data.as_py()):
                    digest = f.get("warc-payload-digest")
                    rows.append((f["warc-type"], f["warc-record-id"], number(f.get("x-page-id")), f.get("warc-target-uri"), digest and digest.removeprefix("sha1:"),
                                 number(f.get("x-refers-to-page-id")), f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")),
                                 number(f.get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 2 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(work, RECORD)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks in (as lists of parts), verified payloads out."""
    for batch in batches:
        payloads, digests = [], []
        for parts, total, told in zip(*(batch.column(c).to_pylist() for c in ("parts", "total", "digest"))):
            block = b"".join(p["block"] for p in parts)
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or total is not None and total != len(block) or total is None and len(parts) > 1:
                raise ValueError("segments are missing, or their total length is wrong")
            payload = payload_of(block)
            digest = digest32(payload)
            if told is not None and told != digest:
                raise ValueError("a payload does not have its digest")
            payloads.append(payload)
            digests.append(digest)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(payloads, pa.binary()), pa.array(digests, pa.string())],
                                         ["page_id", "url", "payload", "digest"])


def read_responses(records: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest`` of each response, put together from its segments.

    Raises where a segment is absent, a total length is wrong, or a payload does not have the digest that its record names.
    """
    part = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "block")
    whole = records.where("type = 'response' and segment is null").select("page_id", "url", "digest", F.array(part).alias("parts"), F.lit(None).cast("long").alias("total"))
    # only segmented records move; a group is one record, which fits a row once it is whole
    cut = (records.where("segment is not null").select(F.coalesce("origin", "name").alias("origin"), "page_id", "url", "digest", "total", part.alias("part"))
           .groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("digest").alias("digest"),
                                  F.array_sort(F.collect_list("part")).alias("parts"), F.max("total").alias("total")))
    return whole.select("page_id", "url", "digest", "parts", "total").unionByName(cut.drop("origin")).mapInArrow(
        _opened, "page_id long, url string, payload binary, digest string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each page in the archives; a revisit takes its length from its response."""
    records = read_records(spark, path)
    found = written(read_responses(records).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest")), "responses")
    sizes = found.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = (records.where("type = 'revisit'").select("page_id", F.col("digest").alias("payload_digest"), "refers_to").join(sizes, "payload_digest")
             .select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)
