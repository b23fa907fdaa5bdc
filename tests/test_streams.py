"""A stream that arrives in several files gives what one batch gives."""

import pytest
from pyspark.sql import functions as F

from loomwork.catalog.aggregates import cart_actions
from loomwork.operators.aggregates import cart_totals
from loomwork.streaming import state as st
from loomwork.streaming import streams as sm
from loomwork.streaming import timed


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    """The events in time order, cut into five files that are read one per micro-batch."""
    path = str(tmp_path_factory.mktemp("events"))
    bounds = events.approxQuantile("event_id", [0.2, 0.4, 0.6, 0.8], 0.0)
    for low, high in zip([-1, *bounds], [*bounds, 10 ** 12]):
        events.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder, events):
    return sm.read_stream(spark, folder, events, bytes_per_batch=1)


def keyed(df, *more):
    return df.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").alias("ident"), *more)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_throttle(spark, folder, events):
    gap = 6 * 3600 * 1_000_000
    out = sm.run_to_end(st.with_state(keyed(stream(spark, folder, events)), "key", st.Throttle(gap)), "t")
    batch = st.throttled(events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", gap)
    assert rows(out.select("key", "ident")) == rows(batch.select("user_id", "event_id"))


def test_ledger(spark, folder, events):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "deposit").otherwise("withdraw").alias("kind")
    out = sm.run_to_end(st.with_state(keyed(stream(spark, folder, events), kind, F.col("value").alias("amount")), "key", st.Ledger()), "l")
    batch = st.ledger(events.select("user_id", "ts", "event_id", kind, "value"), "user_id", ["ts", "event_id"], "kind", "value")
    assert rows(out.select("key", "ident", "accepted", "balance")) == rows(batch.select("user_id", "event_id", "accepted", "balance"))
    assert out.agg(F.min("balance")).first()[0] >= 0


def test_cart(spark, folder, events):
    acts = cart_actions(stream(spark, folder, events))
    acts = keyed(acts, F.col("act").alias("kind"), F.col("item").cast("bigint").alias("item"), F.col("price").alias("amount"))
    out = sm.run_to_end(st.with_state(acts, "key", st.Cart()), "c")
    last = out.groupBy("key").agg(F.max_by(F.struct("items", F.round("total", 2)), "seen").alias("s")).select("key", "s.*")
    batch = cart_totals(cart_actions(events), "user_id", ["ts", "event_id"], "act", "item", "price")
    assert out.count() > last.count()
    assert rows(last) == rows(batch.select("user_id", "items", F.round("total", 2) + 0.0))


def test_throttle_on_a_busy_key(spark):
    import random
    rnd = random.Random(1)
    at, data = 0, []
    for i in range(2000):
        at += rnd.choice([1, 2, 3, 30])
        data.append((1, i, at))
    want, last = [], None
    for _, i, micros in data:
        if last is None or micros - last >= 10:
            want.append(i)
            last = micros
    df = spark.createDataFrame(data, "k long, i long, us long").withColumn("ts", F.timestamp_micros("us"))
    got = st.throttled(df.select("k", "i", "ts"), "k", "ts", "i", 10)
    assert sorted(r.i for r in got.collect()) == want


def test_debounce(spark, folder, events):
    gap = 8 * 3600 * 1_000_000
    batch = sm.debounced(events.select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id", gap)
    batch = set(rows(batch.select("user_id", "ts", "value")))
    out = sm.run_to_end(sm.debounced_stream(stream(spark, folder, events), "user_id", "ts", ["ts", "event_id"], "value", "8 hours", "0 seconds"), "d")
    got = set(rows(out))
    end = max(ts for _, ts, _ in batch)
    assert got <= batch
    assert all((end - ts).total_seconds() < 2 * 86400 for _, ts, _ in batch - got)
    assert got


def test_null_and_nan_keys_fold_as_one_key(spark):
    rows = [(None, 1, 1, "deposit", 10.0), (None, 2, 2, "deposit", 10.0), (None, 3, 3, "deposit", 10.0), (2**53 + 1, 1, 4, "deposit", 5.0), (2**53 + 1, 2, 5, "withdraw", 7.0)]
    df = spark.createDataFrame(rows, "u long, ts long, event_id long, kind string, value double")
    got = {r.event_id: (r.u, r.accepted, r.balance) for r in st.ledger(df, "u", ["ts", "event_id"], "kind", "value").collect()}
    assert got == {1: (None, True, 10.0), 2: (None, True, 20.0), 3: (None, True, 30.0), 4: (2**53 + 1, True, 5.0), 5: (2**53 + 1, False, 5.0)}
    nan = spark.createDataFrame([(float("nan"), k, k, "deposit", 1.0) for k in range(1, 4)], "u double, ts long, event_id long, kind string, value double")
    assert sorted(r.balance for r in st.ledger(nan, "u", ["ts", "event_id"], "kind", "value").collect()) == [1.0, 2.0, 3.0]


HOUR = 3600 * 1_000_000


@pytest.fixture(scope="module")
def shuffled(spark, events, tmp_path_factory):
    """Six files, one per micro-batch, whose rows overlap by up to two hours: the order across micro-batches is not that of time."""
    path = str(tmp_path_factory.mktemp("shuffled"))
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    moved = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(2 * HOUR))
    part = F.least(F.floor((moved - low) * 6 / (high - low + 1)), F.lit(5))
    for k in range(6):
        events.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return path


def timed_run(spark, path, events, processor, delay="3 hours", partition=None):
    return timed.run_flushed([(stream(spark, path, events), "ts")], lambda s: timed.in_order(s, "user_id", "ts", "event_id", F.col("value"), processor, delay), "timed", partition)


def test_debounce_out_of_order_equals_the_batch_and_ends_its_state(spark, shuffled, events):
    out = timed_run(spark, shuffled, events, timed.Debounce(8 * HOUR))
    batch = sm.debounced(events.select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id", 8 * HOUR)
    assert rows(out.table.where("not late").select("key", "ident", "value")) == rows(batch.select("user_id", "event_id", "value"))
    assert out.table.where("late").count() == 0
    assert max(out.state_rows) > 0 and out.state_rows[-1] == 0


def test_quota_and_throttle_out_of_order(spark, shuffled, events):
    out = timed_run(spark, shuffled, events, timed.Quota(24 * HOUR, 2))
    batch = sm.within_quota(events, "user_id", "ts", ["ts", "event_id"], "1 day", 2)
    assert rows(out.table.select("key", "ident")) == rows(batch.select("user_id", "event_id")) and out.state_rows[-1] == 0
    out = timed_run(spark, shuffled, events, timed.Spaced(6 * HOUR))
    batch = st.throttled(events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 6 * HOUR)
    assert rows(out.table.select("key", "ident")) == rows(batch.select("user_id", "event_id")) and out.state_rows[-1] == 0


def test_late_rows_go_apart(spark, events, tmp_path):
    """The second file lies days before the first; the third goes on after it."""
    path, day = str(tmp_path / "late"), 24 * HOUR
    at = lambda n: F.timestamp_micros(F.lit(1_700_000_000_000_000 + n)).cast(events.schema["ts"].dataType)
    frames = [[(1, 10 * day), (2, 10 * day + HOUR)], [(3, day), (4, 10 * day - HOUR)], [(5, 10 * day + 2 * HOUR), (6, 2 * day)]]
    for own in frames:
        one = None
        for ident, micros in own:
            row = events.limit(1).select(*[{"event_id": F.lit(ident).cast("long"), "ts": at(micros), "user_id": F.lit(7).cast("long"), "value": F.lit(1.0)}.get(c, F.col(c)).alias(c)
                                           for c in events.columns])
            one = row if one is None else one.union(row)
        one.coalesce(1).write.mode("append").parquet(path)
    out = timed_run(spark, path, events, timed.VisitTotal(30 * day), "2 hours", "late")
    # 4 is an hour late: in time. 3 and 6 lie days behind.
    assert rows(out.table.where("not late").select("ident", "value")) == [(1, 2.0), (2, 3.0), (4, 1.0), (5, 4.0)]
    assert rows(out.table.where("late").select("ident")) == [(3,), (6,)]
    assert out.state_rows[-1] == 0


def test_interval_join_equals_the_batch_and_empties_its_state(spark, shuffled, events):
    def run(how):
        sides = [(stream(spark, shuffled, events).select("event_id", "user_id", "ts"), "ts"), (stream(spark, shuffled, events).select("event_id", "user_id", "ts"), "ts")]
        return timed.run_flushed(sides, lambda a, b: timed.interval_join(a, b, ("user_id", "user_id"), "ts", "ts", "1 second", "2 hours", "3 hours", how), "join")

    a, b = events.select("event_id", "user_id", "ts").alias("a"), events.select("event_id", "user_id", "ts").alias("b")
    fits = F.expr("a.user_id = b.user_id and b.ts >= a.ts + interval 1 second and b.ts <= a.ts + interval 2 hours")
    for how in ("inner", "left"):
        out = run(how)
        assert rows(out.table.select("l.event_id", F.col("r.event_id").alias("other"))) == rows(a.join(b, fits, how).select("a.event_id", F.col("b.event_id").alias("other")))
        assert max(out.state_rows) > 100 and out.state_rows[-1] == 0


@pytest.mark.parametrize("drift", [-2, 0, 3])
def test_ledger_of_a_hot_account_by_slices(spark, drift):
    """Account 1 holds a third of the rows and passes by slices; the fold is the plain one."""
    df = spark.range(6000).selectExpr(
        "id", "if(id % 3 = 0, 1, id % 15) as account", "if(pmod(xxhash64(id), 10) < 5, 'deposit', if(id % 100 = 1, null, 'withdraw')) as kind",
        f"case when id % 97 = 0 then null when id % 89 = 0 then -1.5D else round(pmod(xxhash64(id, 1), 1000) / 7, 4) + if(pmod(xxhash64(id), 10) < 5, {drift * 10}, 0) end as amount").repartition(5)
    plain, cut = st.ledger(df, "account", ["id"], "kind", "amount"), st.ledger(df, "account", ["id"], "kind", "amount", limit=100)
    assert plain.dtypes == cut.dtypes and rows(plain) == rows(cut)
    balance = {}
    for account, ident, kind, amount, accepted, after in sorted(map(tuple, cut.collect()), key=lambda r: (r[0], r[1])):
        have, units = balance.get(account, 0), None if amount is None else round(amount * 1_000_000)
        ok = units is not None and (units > 0 if kind == "deposit" else units <= have)
        balance[account] = have + (0 if not ok else units if kind == "deposit" else -units)
        assert ok == accepted and round(after * 1_000_000) == balance[account]


def test_covered_slices_are_not_replayed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(st, "ordered_fold", lambda df, *a, real=st.ordered_fold: (seen.append(df.count()), real(df, *a))[1])
    df = spark.range(20000).selectExpr("id", "1 as account", "if(id % 2 = 0, 'deposit', 'withdraw') as kind", "if(id % 2 = 0, 3.0D, 2.0D) as amount")
    out = st.ledger(df, "account", ["id"], "kind", "amount", limit=500)
    assert out.count() == 20000 and seen[0] == 0 and seen[1] < 100
    assert out.where("not accepted").count() == 0 and out.agg(F.max("balance")).first()[0] == 10001.0 + 1


class CountedState:
    """A value state, and timers, that count the messages sent."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def _sent(self):
        self.calls += 1

    def get(self):
        self._sent()
        return self.value

    def update(self, value):
        self._sent()
        self.value = value

    def clear(self):
        self._sent()
        self.value = None

    def registerTimer(self, at):
        self._sent()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._sent()
        self.timers.remove(at)


def test_a_key_is_held_back_with_few_messages():
    """However many rows wait, they are one value, and the timer is known without asking for all timers."""
    from types import SimpleNamespace
    handle = CountedState()
    states = {}
    handle.getValueState = lambda name, schema: states.setdefault(name, CountedState())
    mark = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    sent = lambda: handle.calls + sum(s.calls for s in states.values())
    processor = timed.Spaced(10_000)
    processor.init(handle)
    rows_in = [(7, n * 1000, n, None if n % 3 else 1.0) for n in range(5000)]
    assert list(processor.handleInputRows((7,), iter(rows_in), mark(0))) == []
    assert sent() <= 4 and handle.timers == {1}
    out = list(processor.handleExpiredTimer((7,), mark(2500), None))
    assert [r.ident for r in out] == list(range(0, 2500, 10)) and sent() <= 9
    handle.timers.discard(1)  # as Spark does
    out = list(processor.handleInputRows((7,), iter([(7, 1000, 9999, 0.0)]), mark(9_000_000)))
    assert out[0].late and [r.ident for r in out[1:]] == list(range(2500, 5000, 10))
    assert handle.timers == set() and all(s.value is None for s in states.values())
