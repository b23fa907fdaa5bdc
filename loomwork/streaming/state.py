"""Keyed state: throttle, ledger, cart and running total, on streams and as batch folds.

On a stream the state of a key lives in the state store. In a batch the rows of
a key pass one task in order, a record batch at a time, with only the state
kept. The throttle first cuts each key at its quiet gaps, where the state is
known, so a busy key spreads over tasks. A busy ledger is cut into slices, and
those that surely reject nothing are passed as one sum each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomwork.operators.hot import HOT_ROWS, _small, _staged, crowded, neighbours, running_sum, sliced

Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, start: Callable[[], Any],
                 schema: T.StructType) -> DataFrame:
    """Fold the rows of each key in order; ``step(state, row) -> (state, output row or None)``.

    Memory does not grow with the key: a task sees one record batch and one state.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]
    target = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                # null is a key like any other, and so is NaN
                key = tuple("NaN" if row[i] != row[i] else row[i] for i in at)
                if key != current:
                    current, state = key, start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            made = zip(*out) if out else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(made, target)], schema=target)

    return (df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema))


# ---- the folds: small functions used by the batch and the stream form ----

def throttle_step(gap_us: int):
    def step(last, row):
        micros = row[-1]
        if last is not None and micros - last < gap_us:
            return last, None
        return micros, row[:-1]
    return step


def ledger_step(balance: float, row: tuple) -> tuple[float, tuple]:
    """Rows end with (kind, amount); a withdrawal above the balance is rejected."""
    *rest, kind, amount = row
    ok = amount > 0 if kind == "deposit" else round(amount - balance, 6) <= 0
    if ok:
        balance = round(balance + amount if kind == "deposit" else balance - amount, 6)
    return balance, (*rest, kind, amount, ok, balance)


def throttled(df: DataFrame, key: str, ts: str, ident: str, gap_us: int) -> DataFrame:
    """Rows accepted by a throttle: at least ``gap_us`` after the last accepted row of the key."""
    rows = df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = neighbours(rows, [key], [ts, ident], lambda w: {"__before": F.lag("__us").over(w)}, back=1)
    # after a quiet gap a row is accepted whatever came before, so each burst folds on its own
    fresh = (F.col("__before").isNull() | (F.col("__us") - F.col("__before") >= gap_us)).cast("int")
    rows = running_sum(rows.withColumn("__new", fresh), [key], [ts, ident], "__new", "__burst")
    rows = rows.select(key, "__burst", *[c for c in df.columns if c != key], "__us")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__us"])
    return ordered_fold(rows, [key, "__burst"], [ts, ident], throttle_step(gap_us), lambda: None, schema).drop("__burst")


MICRO = 1_000_000


def _micro_step(balance: int, row: tuple) -> tuple[int, tuple]:
    """The ledger in whole millionths. Rows end with (kind, amount, millionths, whole slice's total or null)."""
    *rest, kind, amount, micros, total = row
    if total is not None:  # a slice without a rejection passes as one row
        return balance + total, (*rest, kind, amount, None, balance)
    ok = micros is not None and (micros > 0 if kind == "deposit" else micros <= balance)
    if ok:
        balance = balance + micros if kind == "deposit" else balance - micros
    return balance, (*rest, kind, amount, ok, balance)


def ledger(df: DataFrame, key: str, order: Sequence[str], kind: str, amount: str, limit: int = HOT_ROWS) -> DataFrame:
    """Rows with ``accepted`` and the ``balance`` after them: a deposit counts if it is positive, any other kind is a withdrawal and counts if the balance covers it.

    Amounts count in millionths, rounded; a null amount is rejected. The rows of an account pass one task in order. An account above ``limit`` rows is cut into slices
    along its order. Were all its rows accepted, its balance would be the running sum; a rejection only raises the balance against that, and it never
    falls below zero. So before a slice it is at least the running sum less the lowest running sum so far, and a slice whose own lowest sum stays
    within that has no rejection: it passes as one row, its total, and its rows get their balances in tasks of their own. Only the slices that bring a
    new lowest sum are replayed row by row, those of one account in one task.
    """
    deposit, m = F.coalesce(F.col(kind) == "deposit", F.lit(False)), F.round(F.col(amount) * MICRO).cast("long")
    rows = df.select(key, *order, kind, amount, m.alias("__m"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("accepted", T.BooleanType()), T.StructField("balance", T.LongType())])
    nothing = F.lit(None).cast("long")

    def in_units(out: DataFrame) -> DataFrame:
        return out.select(key, *order, kind, amount, "accepted", F.round(F.col("balance") / MICRO, 6).alias("balance"))

    hot = crowded(rows, [key], limit)
    plain = rows if hot is None else hot.split(rows, [key])[0]
    out = in_units(ordered_fold(plain.withColumn("__total", nothing), [key], order, _micro_step, lambda: 0, schema))
    if hot is None:
        return out
    s = sliced(hot.split(rows, [key])[1], [key], list(order), hot.rows, limit)
    change = F.when(deposit, F.greatest(F.coalesce("__m", F.lit(0)), F.lit(0))).otherwise(-F.coalesce("__m", F.lit(0)))
    upto = F.sum(change).over(s.window.rowsBetween(Window.unboundedPreceding, 0))
    sums = s.df.withColumn("__upto", upto).groupBy(key, "__slice").agg(F.min("__upto").alias("low"), F.sum(change).alias("__total"))
    # at most two lines a slice; those of one account in order
    before = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    lowest = F.least(F.coalesce(F.min(F.col("start") + F.col("low")).over(before), F.lit(0)), F.lit(0))
    sums = _staged(sums.withColumn("covered", F.col("start") + F.col("low") >= lowest), "slices")
    side = _small(sums.select(F.col(key).alias("__key"), F.col("__slice").alias("__at"), "covered"), 2 * s.slices)
    match = (F.col("__slice") == F.col("__at")) & F.col(key).eqNullSafe(F.col("__key"))
    dealt = s.df.join(side, match).drop("__key", "__at")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    whole = sums.where("covered").select(key, "__slice", *[F.lit(None).cast(kinds[c]).alias(c) for c in (*order, kind, amount, "__m")], "__total")
    line = dealt.where(~F.col("covered")).select(key, "__slice", *order, kind, amount, "__m", nothing.alias("__total")).unionByName(whole)
    full = [schema.fields[0], T.StructField("__slice", s.df.schema["__slice"].dataType), *schema.fields[1:]]
    full = T.StructType([T.StructField(f.name, f.dataType) for f in full])  # a slice's row has nulls
    walked = _staged(ordered_fold(line, [key], ["__slice", *order], _micro_step, lambda: 0, full), "ledger")
    starts = _small(walked.where("accepted is null").select(F.col(key).alias("__key"), F.col("__slice").alias("__at"), F.col("balance").alias("__start")), 2 * s.slices)
    passed = dealt.where("covered").withColumn("__upto", upto).join(starts, match)
    passed = passed.select(key, *order, kind, amount, F.when(deposit, F.coalesce(F.col("__m") > 0, F.lit(False))).otherwise(F.col("__m").isNotNull()).alias("accepted"),
                           (F.col("__start") + F.col("__upto")).alias("balance"))
    return out.unionByName(in_units(walked.where("accepted is not null"))).unionByName(in_units(passed))


# ---- stream processors: rows are (key, micros, ident, ...) ----

class _Ordered(StatefulProcessor):
    """Takes the rows of a key in a micro-batch in (micros, ident) order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.take(key, sorted(rows, key=lambda r: (r["micros"], r["ident"])))

    def close(self) -> None:
        pass


class Throttle(_Ordered):
    output = T.StructType([T.StructField("key", T.LongType()), T.StructField("ident", T.LongType())])

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def open(self, handle):
        self.last = handle.getValueState("last", T.StructType([T.StructField("micros", T.LongType())]))

    def take(self, key, rows):
        step = throttle_step(self.gap_us)
        last = self.last.get()[0] if self.last.exists() else None
        for r in rows:
            last, made = step(last, (r["ident"], r["micros"]))
            if made is not None:
                yield Row(key=key[0], ident=made[0])
        self.last.update((last,))


class RunningTotal(_Ordered):
    output = T.StructType([T.StructField("key", T.LongType()), T.StructField("ident", T.LongType()), T.StructField("total", T.DoubleType())])

    def open(self, handle):
        self.total = handle.getValueState("total", T.StructType([T.StructField("total", T.DoubleType())]))

    def take(self, key, rows):
        total = self.total.get()[0] if self.total.exists() else 0.0
        for r in rows:
            total += r["amount"]
            yield Row(key=key[0], ident=r["ident"], total=total)
        self.total.update((total,))


class Ledger(_Ordered):
    output = T.StructType([T.StructField("key", T.LongType()), T.StructField("ident", T.LongType()),
                           T.StructField("accepted", T.BooleanType()), T.StructField("balance", T.DoubleType())])

    def open(self, handle):
        self.balance = handle.getValueState("balance", T.StructType([T.StructField("balance", T.DoubleType())]))

    def take(self, key, rows):
        balance = self.balance.get()[0] if self.balance.exists() else 0.0
        for r in rows:
            balance, made = ledger_step(balance, (r["ident"], r["kind"], r["amount"]))
            yield Row(key=key[0], ident=r["ident"], accepted=made[-2], balance=made[-1])
        self.balance.update((balance,))


class Cart(_Ordered):
    """Items of a cart as map state: item -> (first price, pieces). Emits the cart after each micro-batch."""

    output = T.StructType([T.StructField("key", T.LongType()), T.StructField("seen", T.LongType()),
                           T.StructField("items", T.LongType()), T.StructField("total", T.DoubleType())])

    def open(self, handle):
        self.held = handle.getMapState("held", T.StructType([T.StructField("item", T.LongType())]),
                                       T.StructType([T.StructField("price", T.DoubleType()), T.StructField("pieces", T.LongType())]))
        self.sums = handle.getValueState("sums", T.StructType([
            T.StructField("seen", T.LongType()), T.StructField("items", T.LongType()), T.StructField("total", T.DoubleType())]))

    def take(self, key, rows):
        seen, items, total = tuple(self.sums.get()) if self.sums.exists() else (0, 0, 0.0)
        for r in rows:
            seen += 1
            item = (r["item"],)
            if r["kind"] == "add":
                first, pieces = tuple(self.held.getValue(item)) if self.held.containsKey(item) else (r["amount"], 0)
                self.held.updateValue(item, (first, pieces + 1))
                items, total = items + 1, total + r["amount"]
            elif r["kind"] == "remove" and self.held.containsKey(item):
                first, pieces = tuple(self.held.getValue(item))
                self.held.removeKey(item)
                items, total = items - pieces, total - first
            elif r["kind"] == "clear":
                self.held.clear()
                items, total = 0, 0.0
        self.sums.update((seen, items, total))
        yield Row(key=key[0], seen=seen, items=items, total=total)


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, mode: str = "Append") -> DataFrame:
    return stream.groupBy(key).transformWithState(processor, processor.output, outputMode=mode, timeMode="None")
