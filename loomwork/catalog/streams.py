"""Streaming operators. Streams read the events file as a source and must give what a batch gives."""

from pyspark.sql import functions as F

from loomwork.catalog.aggregates import ACTIONS, cart_actions
from loomwork.catalog.registry import ORACLE, query
from loomwork.catalog.select import event_note
from loomwork.streaming import state as st
from loomwork.streaming import streams as sm
from loomwork.streaming import timed

c = F.col
SIX_HOURS = 6 * 3600 * 1_000_000

THROTTLE = """
    with recursive e as (select user_id, ts, event_id from events),
    f as (select user_id, min(struct_pack(ts := ts, id := event_id)) as x from e group by user_id
        union all select f.user_id, min(struct_pack(ts := e.ts, id := e.event_id)) from f join e on e.user_id = f.user_id and e.ts >= f.x.ts + interval 6 hour group by f.user_id, f.x)
    select user_id, x.id as event_id from f"""

LEDGER = """
    with recursive n as (select user_id, event_id, case when event_type in ('signup', 'purchase') then 'deposit' else 'withdraw' end as kind, value,
        row_number() over (partition by user_id order by ts, event_id) as rn from events),
    f as (select user_id, event_id, rn, case when kind = 'deposit' then value > 0 else value <= 0 end as accepted, case when kind = 'deposit' then value else 0.0 end as balance from n where rn = 1
        union all select n.user_id, n.event_id, n.rn, case when kind = 'deposit' then value > 0 else round(value - balance, 6) <= 0 end,
          round(case when kind = 'deposit' then balance + value when round(value - balance, 6) <= 0 then balance - value else balance end, 6) from f join n on n.user_id = f.user_id and n.rn = f.rn + 1)
    select user_id, event_id, accepted, round(balance, 4) as balance from f"""


def event_stream(t):
    return sm.read_stream(t.spark, t.folder, t.events, "events.parquet")


def keyed(df, *more):
    return df.select(c("user_id").alias("key"), F.unix_micros(c("ts").cast("timestamp")).alias("micros"), c("event_id").alias("ident"), *more)


def ledger_kind():
    return F.when(c("event_type").isin("signup", "purchase"), "deposit").otherwise("withdraw").alias("kind")


@query("stream_classify", ORACLE["event_classify"])
def stream_classify(t):
    return sm.run_to_end(event_stream(t).select("event_id", event_note().alias("note")), "classified")


def in_time(t, processor, name):
    """All results of a processor over the events, which lie at most ten minutes out of order."""
    ended = timed.run_flushed([(event_stream(t), "ts")], lambda s: timed.in_order(s, "user_id", "ts", "event_id", c("value"), processor, "10 minutes"), name, "late")
    return ended.table.where("not late").select(c("key").alias("user_id"), c("ident").alias("event_id"), F.timestamp_micros("micros").alias("ts"), "value")


@query("stream_throttle", THROTTLE)
def stream_throttle(t):
    return in_time(t, timed.Spaced(SIX_HOURS), "throttled").select("user_id", "event_id")


@query("stream_debounce", "select user_id, event_id, value from events qualify coalesce(lead(ts) over (partition by user_id order by ts, event_id) - ts >= interval 8 hour, true)")
def stream_debounce(t):
    return in_time(t, timed.Debounce(8 * 3600 * 1_000_000), "debounced").select("user_id", "event_id", "value")


@query("stream_quota", """
    select user_id, event_id from events qualify row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) <= 2""")
def stream_quota(t):
    return in_time(t, timed.Quota(24 * 3600 * 1_000_000, 2), "within-quota").select("user_id", "event_id")


@query("stream_visit_total", """
    select user_id, event_id, round(sum(value) over (partition by user_id, visit order by ts, event_id), 4) as total from
    (select *, sum(fresh) over (partition by user_id order by ts, event_id) as visit from
     (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hour then 0 else 1 end as fresh from events))""")
def stream_visit_total(t):
    return in_time(t, timed.VisitTotal(12 * 3600 * 1_000_000), "visits").select("user_id", "event_id", F.round("value", 4).alias("total"))


@query("stream_interval_join", """
    select p.event_id as purchase, k.event_id as click from (select * from events where event_type = 'purchase') p
    left join (select * from events where event_type = 'click') k on p.user_id = k.user_id and k.ts >= p.ts - interval 1 hour and k.ts <= p.ts + interval 5 hour""")
def stream_interval_join(t):
    p, k = (event_stream(t).select("event_id", "user_id", "ts", "event_type") for _ in "pk")

    def make(left, right):
        of = lambda df, kind: df.where(f"event_type = '{kind}' or ts > timestamp'8000-01-01'")  # noqa: E731 (the end of a stream has no kind)
        return timed.interval_join(of(left, "purchase"), of(right, "click"), ("user_id", "user_id"), "ts", "ts", "-1 hour", "5 hours", "10 minutes", "left")

    ended = timed.run_flushed([(p, "ts"), (k, "ts")], make, "interval-join")
    return ended.table.select(c("l.event_id").alias("purchase"), c("r.event_id").alias("click"))


@query("throttle", THROTTLE)
def throttle(t):
    return st.throttled(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", SIX_HOURS).select("user_id", "event_id")


@query("debounce", """
    select user_id, ts as settled_at, value from events
    qualify coalesce(lead(ts) over (partition by user_id order by ts, event_id) - ts >= interval 8 hour, true)""")
def debounce(t):
    rows = t.events.select("user_id", "ts", "event_id", "value")
    return sm.debounced(rows, "user_id", "ts", "event_id", 8 * 3600 * 1_000_000).select("user_id", c("ts").alias("settled_at"), "value")


@query("stream_state", ORACLE["event_fold"])
def stream_state(t):
    acts = cart_actions(event_stream(t))
    rows = acts.select(c("user_id").alias("key"), F.unix_micros(c("ts").cast("timestamp")).alias("micros"), c("event_id").alias("ident"),
                       c("act").alias("kind"), c("item").cast("bigint").alias("item"), c("price").alias("amount"))
    out = sm.run_to_end(st.with_state(rows, "key", st.Cart()), "carts")
    # every micro-batch that touches a cart adds a version; the one that saw most is the last
    last = out.groupBy(c("key").alias("user_id")).agg(F.max_by(F.struct("items", "total"), "seen").alias("s"))
    return last.select("user_id", "s.items", (F.round("s.total", 2) + F.lit(0.0)).alias("total"))


@query("stream_running_total", ORACLE["running_total"])
def stream_running_total(t):
    out = sm.run_to_end(st.with_state(keyed(event_stream(t), c("value").alias("amount")), "key", st.RunningTotal()), "totals")
    return out.select(c("key").alias("user_id"), c("ident").alias("event_id"), F.round("total", 4).alias("total"))


@query("quota_window", """
    select user_id, event_id from events qualify row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) <= 2""")
def quota_window(t):
    return sm.within_quota(t.events, "user_id", "ts", ["ts", "event_id"], "1 day", 2).select("user_id", "event_id")


@query("first_success", """
    select user_id, coalesce(arg_min(event_type || ':' || event_id, (value, event_id)) filter (where event_type not in ('error', 'view') and value < 12), 'fallback') as result
    from events group by user_id""")
def first_success(t):
    healthy = ~c("event_type").isin("error", "view") & (c("value") < 12)
    return sm.first_success(t.events, "user_id", healthy, F.struct("value", "event_id"),
                            F.concat("event_type", F.lit(":"), c("event_id").cast("string")), "fallback")


@query("stream_map", "select event_id, round(value * value, 4) as square, row_number() over (order by value * value, event_id) as position from events")
def stream_map(t):
    from loomwork.operators.ordering import sorted_positions
    squares = sm.run_to_end(event_stream(t).select("event_id", (c("value") * c("value")).alias("sq")), "squares")
    return sorted_positions(squares, ["sq", "event_id"]).select("event_id", F.round("sq", 4).alias("square"), "position")


@query("ledger", LEDGER)
def ledger(t):
    rows = t.events.select("user_id", "ts", "event_id", ledger_kind(), "value")
    return (st.ledger(rows, "user_id", ["ts", "event_id"], "kind", "value")
            .select("user_id", "event_id", "accepted", F.round("balance", 4).alias("balance")))


@query("stream_ledger", LEDGER)
def stream_ledger(t):
    rows = keyed(event_stream(t), ledger_kind(), c("value").alias("amount"))
    out = sm.run_to_end(st.with_state(rows, "key", st.Ledger()), "ledgers")
    return out.select(c("key").alias("user_id"), c("ident").alias("event_id"), "accepted", F.round("balance", 4).alias("balance"))
