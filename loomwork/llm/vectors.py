"""What the operators on embeddings share: which rows count, exact whole-number components, exact sums over tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers up to here: squared distances of vectors with up to 1024 components fit 64 bits. Arrays with larger ones hold Python's own integers.
NARROW = 1 << 25

#: Sums of wide numbers travel in parts of so many bits.
LIMB = 40

SUMS = "slot int, position int, limb int, value long"


def numbers(table: DataFrame, vector_col: str) -> Column:
    """The vector column, as it is if it holds float or double components, else as double."""
    kind = table.schema[vector_col].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    return F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")


def finite(vector: str) -> Column:
    """Is the vector there, without null or non-finite components?"""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def matrix(batch: pa.RecordBatch, dim: int, column: str = "v") -> np.ndarray:
    """The vectors of a batch as rows of doubles."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)


def narrowed(rows: list[list[int]], dim: int) -> np.ndarray:
    """Whole numbers as int64 where that is safe, else as Python's integers."""
    wide = any(abs(x) > NARROW for r in rows for x in r)
    return np.array(rows, object if wide else np.int64).reshape(len(rows), dim)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact for every finite double."""
    with np.errstate(over="ignore"):
        f = np.floor(x * scale)
    if f.size == 0 or np.abs(f).max() <= NARROW:
        return f.astype(np.int64)
    out = [int(a) if np.isfinite(a) else int(b) * scale for a, b in zip(f.ravel().tolist(), x.ravel().tolist())]
    return np.array(out, object).reshape(x.shape)


def sum_rows(totals: dict[int, tuple[int, Sequence[int]]]) -> pa.RecordBatch:
    """Per slot a count (position -1) and sums by position, as rows that Spark can add up exactly."""
    slot, position, limb, value = [], [], [], []
    for s, (count, sums) in totals.items():
        for p, total in enumerate([count, *sums], -1):
            k, total = 0, int(total)
            while total or k == 0:
                # the last part keeps the sign
                part = total if -(1 << LIMB) < total < 1 << LIMB else total & ((1 << LIMB) - 1)
                slot.append(s), position.append(p), limb.append(k), value.append(part)
                total, k = (total - part) >> LIMB, k + 1
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip((slot, position, limb, value), (pa.int32(),) * 3 + (pa.int64(),))],
                                      ["slot", "position", "limb", "value"])


def added(rows: DataFrame) -> dict[int, dict[int, int]]:
    """slot -> position -> sum. As many numbers as slots and positions come to the driver, whatever the rows."""
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("slot", "position", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        at = out.setdefault(r["slot"], {})
        at[r["position"]] = at.get(r["position"], 0) + (int(r["value"]) << (LIMB * r["limb"]))
    return out


def longs(values: np.ndarray) -> pa.Array:
    """Whole numbers as long; null where one is too large for it."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if abs(v) < 1 << 63 else None for v in values], pa.int64())


def long_sum(column: str) -> Column:
    """The sum of a long column; null where a value is null or the sum is too large."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when((F.count(column) == F.count(F.lit(1))) & (F.abs(total) <= F.lit((1 << 63) - 1).cast("decimal(38,0)")), total).cast("long")
