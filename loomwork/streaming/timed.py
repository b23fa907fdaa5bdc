"""Event-time streams: rows in order across micro-batches, late rows apart, state that ends.

A processor here holds the rows of a key back until the watermark has passed
their time; then no earlier row can come, and they are taken in order, whatever
micro-batch they arrived in. Rows that arrive behind the watermark are given out
as late and go to a table of their own. Timers wake a key that gets no more rows, so
pending results come out and state is cleared once time has passed.

Sources are finite folders of files, read to their end; then one row far in the
future moves the watermark on, so that what is still pending comes out too.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomwork.session import fresh_path

#: The time of the row that ends a stream, and the limit above which a row is such an end.
END = datetime.datetime(9000, 1, 1)
LAST = datetime.datetime(8000, 1, 1)

ROW = [T.StructField("micros", T.LongType()), T.StructField("ident", T.LongType()), T.StructField("value", T.DoubleType())]


#: What a key holds back, column by column in one value, and when its timer is set. (A list state would pass every row to the state store by itself.)
HELD = T.StructType([T.StructField("timer", T.LongType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in ROW]])

_Out = Row("key", "micros", "ident", "value", "late")


class InOrder(StatefulProcessor):
    """Rows are (key, micros, ident, value). ``take`` gets those that are due, in order, and yields results; ``due_at``, asked after it, says when it must be called again.

    Every call of the state store is a message to the JVM, so state is read once, written only where it changes, and the key's one timer is known from it.
    """

    output = T.StructType([T.StructField("key", T.LongType()), *ROW, T.StructField("late", T.BooleanType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", HELD)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def take(self, rows: list, mark: int) -> Iterator[tuple]:
        raise NotImplementedError

    def due_at(self) -> int | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, was = timerValues.getCurrentWatermarkInMs() * 1000, self.waiting.get()
        held = self._rows(was)
        for _, micros, ident, value in rows:
            if micros < mark:
                yield _Out(key[0], micros, ident, value, True)
            else:
                held.append((micros, ident, value))
        yield from self._release(key, held, mark, was, was[0] if was else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        was = self.waiting.get()
        # Spark takes the expired timer away itself
        yield from self._release(key, self._rows(was), timerValues.getCurrentWatermarkInMs() * 1000, was, None)

    @staticmethod
    def _rows(was) -> list[tuple]:
        return list(zip(*was[1:])) if was else []

    def _release(self, key, held: list[tuple], mark: int, was, timer: int | None) -> Iterator[Row]:
        due = sorted(r for r in held if r[0] < mark)
        rest = [r for r in held if r[0] >= mark] if due else held
        for micros, ident, value in self.take(due, mark):
            yield _Out(key[0], micros, ident, value, False)
        # one timer: when the next row is due, or the state has something to do
        times = [t for t in (min((r[0] for r in rest), default=None), self.due_at()) if t is not None]
        # the first millisecond at which the time has passed
        at = min(times) // 1000 + 1 if times else None
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if at is not None:
            self.waiting.update((at, *(map(list, zip(*rest)) if rest else ([], [], []))))
        elif was is not None:
            self.waiting.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def keep(state, was, now) -> None:
        """Set a value state to ``now``, or end it (None); nothing is sent if it stays as it ``was``."""
        if now is None and was is not None:
            state.clear()
        elif now is not None and now != was:
            state.update(now)


class Debounce(InOrder):
    """Rows after which the key is quiet for at least ``gap_us``."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def open(self, handle):
        self.last = handle.getValueState("last", T.StructType(ROW))

    def take(self, rows, mark):
        was = self.last.get()
        last = was = was and tuple(was)
        for r in rows:
            if last is not None and r[0] - last[0] >= self.gap_us:
                yield last
            last = r
        if last is not None and last[0] + self.gap_us <= mark:
            yield last
            last = None
        self.keep(self.last, was, last)
        self.due = None if last is None else last[0] + self.gap_us

    def due_at(self):
        return self.due


class Quota(InOrder):
    """The first ``quota`` rows of each tumbling window of ``window_us``; the count ends with the window."""

    def __init__(self, window_us: int, quota: int):
        self.window_us, self.quota = window_us, quota

    def open(self, handle):
        self.count = handle.getValueState("count", T.StructType([T.StructField("window", T.LongType()), T.StructField("n", T.LongType())]))

    def take(self, rows, mark):
        was = self.count.get()
        was = was and tuple(was)
        window, n = was or (None, 0)
        for r in rows:
            at = r[0] // self.window_us
            window, n = at, (n if at == window else 0) + 1
            if n <= self.quota:
                yield r
        ended = window is None or (window + 1) * self.window_us <= mark
        self.keep(self.count, was, None if ended else (window, n))
        self.due = None if ended else (window + 1) * self.window_us

    def due_at(self):
        return self.due


class Spaced(InOrder):
    """Rows at least ``gap_us`` after the last row given out; the state ends once the gap has passed."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def open(self, handle):
        self.last = handle.getValueState("last", T.StructType([T.StructField("micros", T.LongType())]))

    def take(self, rows, mark):
        was = self.last.get()
        was = was and tuple(was)
        last = was[0] if was else None
        for r in rows:
            if last is None or r[0] - last >= self.gap_us:
                last = r[0]
                yield r
        ended = last is None or last + self.gap_us <= mark
        self.keep(self.last, was, None if ended else (last,))
        self.due = None if ended else last + self.gap_us

    def due_at(self):
        return self.due


class VisitTotal(InOrder):
    """Running total of ``value`` (null: 0) that starts again, and whose state ends, when the key is quiet for ``idle_us``."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def open(self, handle):
        self.total = handle.getValueState("total", T.StructType([T.StructField("micros", T.LongType()), T.StructField("total", T.DoubleType())]))

    def take(self, rows, mark):
        was = self.total.get()
        was = was and tuple(was)
        last, total = was or (None, 0.0)
        for micros, ident, value in rows:
            total = (0.0 if last is None or micros - last >= self.idle_us else total) + (value or 0.0)
            last = micros
            yield micros, ident, total
        ended = last is None or last + self.idle_us <= mark
        self.keep(self.total, was, None if ended else (last, total))
        self.due = None if ended else last + self.idle_us

    def due_at(self):
        return self.due


def in_order(stream: DataFrame, key: str, ts: str, ident: str, value: Column, processor: InOrder, delay: str) -> DataFrame:
    """``key, micros, ident, value, late``: the processor's rows, and as they came (``late``) those more than ``delay`` behind the latest row seen before their micro-batch.

    Rows without a key or a time are left out.
    """
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    # the rows go on without the watermarked column, so that Spark leaves late ones to the processor
    rows = rows.where((F.col("__ts") < F.lit(LAST)) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), F.unix_micros("__ts").alias("micros"), F.col(ident).cast("long").alias("ident"), value.cast("double").alias("value"))
    return rows.groupBy("key").transformWithState(processor, processor.output, outputMode="Append", timeMode="EventTime")


def interval_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], left_time: str, right_time: str, after: str, before: str, delay: str, how: str = "inner") -> DataFrame:
    """Rows of two streams with equal keys whose times fit: ``left_time + after <= right_time <= left_time + before`` (intervals like ``"1 hour"``, ``"-5 minutes"``).

    Columns ``l`` and ``r`` hold the rows as structs. ``how`` is ``inner`` or ``left`` (left rows without a partner come out, with a null ``r``, when none can come any more).
    Both states are bounded by the times: a row leaves once the watermark has passed the last partner it could have. Rows more than ``delay`` late are left out.
    """
    a = left.select(F.struct("*").alias("l"), F.col(keys[0]).alias("__lk"), F.col(left_time).cast("timestamp").alias("__lt")).withWatermark("__lt", delay)
    b = right.select(F.struct("*").alias("r"), F.col(keys[1]).alias("__rk"), F.col(right_time).cast("timestamp").alias("__rt")).withWatermark("__rt", delay)
    a, b = a.where(F.col("__lt") < F.lit(LAST)), b.where(F.col("__rt") < F.lit(LAST))
    fits = F.expr(f"__lk = __rk and __rt >= __lt + interval {after} and __rt <= __lt + interval {before}")
    return a.join(b, fits, "left_outer" if how == "left" else how).select("l", "r")


def _filler(kind: T.DataType) -> Column:
    """A value that a test for null does not drop before the watermark has seen its row."""
    if isinstance(kind, T.NumericType):
        return F.lit(0)
    return F.lit("") if isinstance(kind, T.StringType) else F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(None)


@dataclass
class Ended:
    """What a stream gave: its table, and the rows left in its state after each micro-batch."""

    table: DataFrame
    state_rows: list[int]
    state_path: str


def run_flushed(sources: list[tuple[DataFrame, str]], make: Callable[..., DataFrame], name: str, partition: str | None = None) -> Ended:
    """Run ``make(*streams)`` over all data of the sources, then end them, so that all that is pending comes out.

    sources: (stream, time column). A source is ended by one row far in the future, whose numbers are 0 and whose texts are empty; ``make`` must put a watermark on that time
    and then leave out what lies after ``LAST``. ``partition`` is a column by which the table is laid out in folders.
    """
    spark = sources[0][0].sparkSession
    ends = [fresh_path(spark, f"{name}-end") for _ in sources]
    for (stream, _), path in zip(sources, ends):
        spark.createDataFrame([], stream.schema).write.parquet(path)
    target, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    rows = []

    def run() -> T.StructType:
        out = make(*[s.unionByName(spark.readStream.schema(s.schema).parquet(path)) for (s, _), path in zip(sources, ends)])
        writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
        query = (writer.partitionBy(partition) if partition else writer).trigger(availableNow=True).start(target)
        query.awaitTermination()
        rows.extend(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress)
        return out.schema

    run()
    for (stream, ts), path in zip(sources, ends):
        one = spark.range(1).select(*[(F.lit(END) if f.name == ts else _filler(f.dataType)).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
        one.write.mode("append").parquet(path)
    schema = run()
    return Ended(spark.read.schema(schema).parquet(target), rows, state)
