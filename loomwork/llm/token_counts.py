"""Token counts with a cache of digests.

A count is stored under (content digest, tokenizer digest). Texts are joined to
the stored counts by digest; only distinct texts without a stored count are
encoded, and their counts are appended to the cache.

Where the tokenizer's own rule says that no token crosses the gap between words, a
Python worker gives a repeated piece between two gaps to the library once and adds up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter as Tally
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import slices
from loomwork.session import fresh_path

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"

#: The byte-level rule ends a word before white space and does not look back, so a text may be cut before a space or line break that follows a visible character.
GAP = re.compile(r"(?<=\S)(?=[ \n])")

#: Pieces whose counts a Python worker keeps (some 150 bytes each), characters of a piece that is kept, and pieces encoded at a time.
KEPT_PIECES = 1 << 19
KEPT_CHARS = 64
ENCODED_PIECES = 10_000

Counter = Callable[[list[str]], list[int]]

#: The counter that this process used last; Spark keeps its Python workers from task to task.
_loaded: dict[str, Counter] = {}


def _cut_at_gaps(file: dict) -> bool:
    """Whether a tokenizer file counts the pieces between gaps as it counts the whole text."""
    pre, model, post = (file.get(k) or {} for k in ("pre_tokenizer", "model", "post_processor"))
    return (file.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and post.get("type", "ByteLevel") == "ByteLevel" and model.get("type") == "BPE" and not model.get("dropout")
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file.get("added_tokens") or []))


def by_pieces(count: Counter) -> Counter:
    """``count`` as a sum over the pieces between gaps: a piece met twice in a call is given to ``count`` once and kept, the other pieces of a text go to it together."""
    known: dict[str, int] = {}

    def total(texts: list[str]) -> list[int]:
        if len(known) > KEPT_PIECES:
            known.clear()
        pieces = [GAP.split(text) for text in texts]
        met = Tally(chain.from_iterable(pieces))
        new = [p for p, n in met.items() if n > 1 and len(p) <= KEPT_CHARS and p not in known]
        for at in range(0, len(new), ENCODED_PIECES):
            part = new[at:at + ENCODED_PIECES]
            known.update(zip(part, count(part), strict=True))
        # the gaps between them stay: all pieces but a text's first begin with white space, all but its last end visibly
        rest = count(["".join([p for p in text if p not in known]) for text in pieces])
        return [n + sum([known[p] for p in text if p in known]) for n, text in zip(rest, pieces, strict=True)]

    return total


class Tokenizer:
    """A public tokenizer file: ``.json`` for the tokenizers library, ``.model`` for sentencepiece.

    The file's bytes travel with the job, so executors need the library but not the file.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.kind = os.path.splitext(path)[1]
        if self.kind not in (".json", ".model"):
            raise ValueError(f"{path}: a .json or .model file is needed")
        # the version: the vocabulary file and the options that change a count
        self.version = hashlib.sha256(self.kind.encode() + b"\0no-added-tokens\0" + self.data).hexdigest()

    def counter(self) -> Counter:
        if self.version not in _loaded:
            _loaded.clear()
            _loaded[self.version] = self._load()
        return _loaded[self.version]

    def _load(self) -> Counter:
        if self.kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Library

            lib = Library.from_str(self.data.decode())
            lib.no_truncation()
            lib.no_padding()

            def count(texts: list[str]) -> list[int]:
                return [len(e) for e in lib.encode_batch_fast(texts, add_special_tokens=False)]

            return by_pieces(count) if _cut_at_gaps(json.loads(self.data)) else count
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]


def normalised(col):
    """What a digest is taken of: the text itself, null as empty. (Any other change could change a count.)"""
    return F.coalesce(col.cast("string"), F.lit(""))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts, one row a key; an absent cache is empty."""
    # two jobs that ran side by side may both have stored a text; their counts are equal
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def content_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def add_misses(docs: DataFrame, tokenizer: Tokenizer, cache: str, text_col: str = "text") -> None:
    """Encode the distinct texts of ``docs`` that have no stored count, and append their counts to the cache."""
    known = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == tokenizer.version).select("content").distinct()
    # one row a text and task before the shuffle: a text that fills a third of the table stays small. The texts are then dealt by digest already,
    # so they travel once, and the hash join spares their sort
    texts = docs.select(normalised(F.col(text_col)).alias("text")).groupBy(content_digest(F.col("text")).alias("content")).agg(F.first("text").alias("text"))
    misses = texts.join(known.hint("shuffle_hash"), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.counter()
        for batch in slices(batches, "text"):
            n = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([tokenizer.version] * len(n), pa.string()), pa.array(n, pa.int64())],
                                             ["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, content`` for each row, with counts as the tokenizer's library gives them.

    No begin, end or other added tokens; strings of special tokens inside a text are handled as the library
    does by default. A null text counts as empty (0 tokens). Repeated rows and texts come back as often as they
    are there; null and repeated ids are kept. An empty table gives an empty result and stores nothing. Further columns are ignored.
    """
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token-cache")
    text = normalised(F.col(text_col))
    # the digests are taken anew for the second read: cheaper than writing them
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("content"))
    add_misses(docs, tokenizer, cache, text_col)
    stored = read_cache(spark, cache).where(F.col("tokenizer") == tokenizer.version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(stored, "content").select(id_col, "n_bytes", "n_tokens", "content")
