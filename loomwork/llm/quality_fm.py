"""Quality scores from a factorisation machine.

Inputs are hashed words, statistics of the text's structure and named metadata
columns. Their pairwise interactions have low rank: with a factor vector for each
input, the sum over all pairs is half of (square of the sum - sum of the squares),
so a text is scored in time linear in its inputs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import free_names, slices, texts_of

#: Rows that a model is fitted on, at most; half of each label.
TRAIN_ROWS = 4096
BUCKETS = 1024
FACTORS = 8
STEPS = 150

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
MARKS = b"#*$%&|<>{}[]=~^_\\/@"
STATS = 14


def _rate(text: bytes, chars: bytes) -> float:
    return 1 - len(text.translate(None, chars)) / max(1, len(text))


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n = max(1, len(words))
    lines = text.split(b"\n")
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / n, len(counts) / n, top / n,
        _rate(text, UPPER), _rate(text, LETTERS), _rate(text, DIGITS), _rate(text, MARKS), _rate(text, b"|"), _rate(text, b"!"),
        1 - len(set(lines)) / max(1, len(lines)), sum(w[-1:] in b".!?" for w in words) / n,
    ]


def features(texts: list[bytes], metadata: np.ndarray, buckets: int) -> np.ndarray:
    """A row of inputs for each text: bucket weights of Euclidean length 1 (the roots of word shares), structure, metadata."""
    cells, weights, rest = [], [], np.zeros((len(texts), STATS))
    for r, text in enumerate(texts):
        words = text.lower().split()
        counts = Counter(words)
        rest[r] = structure(text, words, counts)
        cells.append(np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % buckets + r * buckets)
        weights.append(np.fromiter(counts.values(), np.float64, len(counts)) / max(1, len(words)))
    shares = np.bincount(np.concatenate([np.zeros(0, np.int64), *cells]), np.concatenate([np.zeros(0), *weights]), len(texts) * buckets)
    return np.concatenate([np.sqrt(shares.reshape(len(texts), buckets)), rest, metadata], axis=1)


@dataclass
class Model:
    """A fitted machine; without both labels in the sample every score is ``prior``."""

    buckets: int
    metadata: tuple[str, ...]
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    bias: float = 0.0
    weight: np.ndarray | None = None
    factor: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(margin(self.scaled(x), self.bias, self.weight, self.factor), -30, 30)))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)


def margin(x: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """bias + linear part + all pairs, by the sum-of-squares identity."""
    total = x @ factor
    return bias + x @ weight + 0.5 * ((total ** 2).sum(axis=1) - (x ** 2) @ (factor ** 2).sum(axis=1))


def fit(x: np.ndarray, y: np.ndarray, share: float, model: Model, factors: int = FACTORS, steps: int = STEPS, decay: float = 1e-3, seed: int = 7) -> Model:
    """Full-batch Adam on the log-loss; rows are weighted so that label 1 has the share it has among all labelled rows."""
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    words = model.buckets
    model.mean[:words], model.scale[:words] = 0, 0.25  # word weights stay sparse; a rare word doesn't outweigh the structure
    x = model.scaled(x).astype(np.float32)
    rng = np.random.default_rng(seed)
    p = [np.array([np.log(share / (1 - share))]), np.zeros(x.shape[1]), rng.normal(0, 0.01, (x.shape[1], factors))]
    one = y.mean()
    importance = np.where(y == 1, share / one, (1 - share) / (1 - one)) / len(y)
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    square = x ** 2
    for step in range(1, steps + 1):
        g = (1 / (1 + np.exp(-np.clip(margin(x, p[0][0], p[1], p[2]), -30, 30))) - y) * importance
        grads = [np.array([g.sum()]), x.T @ g + decay * p[1], x.T @ (g[:, None] * (x @ p[2])) - (square.T @ g)[:, None] * p[2] + decay * p[2]]
        for k in range(3):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.99 * v[k] + 0.01 * grads[k] ** 2
            p[k] -= 0.03 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-9)
    model.bias, model.weight, model.factor = float(p[0][0]), p[1], p[2]
    return model


def held_out(id_col: Column) -> Column:
    """Is the row kept from training? CRC-32 of the id as text, modulo 5, is 0. (A null id: no.)"""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _inputs(text_col: str, metadata: Sequence[str], names: Sequence[str] = ("__text", "__meta")) -> list[Column]:
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in metadata]
    return [F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(names[0]), F.array(*[F.log1p(F.greatest(n, F.lit(0.0))) for n in numbers]).cast("array<double>").alias(names[1])]


def _matrix(batch: pa.RecordBatch, buckets: int, n_meta: int, names: Sequence[str] = ("__text", "__meta")) -> np.ndarray:
    meta = np.array(batch.column(names[1]).to_pylist(), np.float64).reshape(batch.num_rows, n_meta)
    return features(texts_of(batch, names[0]), meta, buckets)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: Sequence[str] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Model:
    """A model fitted on at most ``train_rows`` labelled rows outside the held-out fifth, half of each label, picked by a hash of their ids.

    Ids with contradicting or null labels are left out; of rows that repeat an id one counts. The label, the id, ``lang`` and ``source`` are no inputs.
    Without labels the prior is one half, with labels of one kind only it is that kind's smoothed share.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y_most")).where("y = y_most").where(~held_out(F.col("id"))))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = Model(buckets, tuple(metadata), (totals.get(1, 0) + 1) / (sum(totals.values()) + 2))
    if len(totals) < 2:
        return model
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(train_rows // 2).select("id", "y") for y in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most train_rows rows
    rows = docs.select(F.col(id_col).alias("id"), *_inputs(text_col, metadata)).join(sample, "id").dropDuplicates(["id"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            x = _matrix(batch, buckets, len(metadata)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(work, f"id {kind}, y int, x binary").toArrow().sort_by("id")
    y = found.column("y").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return model
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(len(y), -1).astype(np.float64)
    return fit(x, y, totals[1] / sum(totals.values()), model)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__score") -> DataFrame:
    """``docs`` with a further column ``name`` (0 to 1, higher: label 1 likelier), for every row, from its whole text.

    A null text counts as empty, which has a score too; null metadata counts as 0. All columns are passed on whatever their names; ``name`` must be none of them.
    """
    names = free_names(docs, "__text", "__meta")
    given = docs.select("*", *_inputs(text_col, model.metadata, names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[0]):
            scores = model.scores(_matrix(batch, model.buckets, len(model.metadata), names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(scores, pa.float64())], [*batch.schema.names[:-2], name])

    return given.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
