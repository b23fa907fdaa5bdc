"""Date and time functions."""

import datetime

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.functions import dates as d

c = F.col
CLOSED_DAYS = ((1, 1), (5, 1), (12, 25), (12, 26))
CALENDAR_SQL = """
    days as (select cast(unnest(generate_series((select cast(min(o_orderdate) as date) - 31 from orders), (select cast(max(o_orderdate) as date) + 183 from orders), interval 1 day)) as date) as day),
    cal as (select day, dayofweek(day) not in (0, 6) and strftime(day, '%m-%d') not in ('01-01', '05-01', '12-25', '12-26') as is_open from days),
    num as (select *, sum(is_open::int) over (order by day) as open_no from cal)"""


def closed_days(t):
    """The days that are closed in each year of the order dates and the one before and after."""
    low, high = t.orders.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return [datetime.date(y, m, day) for y in range((low or 1) - 1, (high or 0) + 2) if 1 <= y <= 9999 for m, day in CLOSED_DAYS]


@query("add_days", """
    select o_orderkey, cast(o_orderdate + interval 15 day as date) as plus15, cast(o_orderdate + interval 1 day as date) as next,
           strftime(date '2024-05-23' + interval 30 day, '%d/%m/%Y') as available from orders""")
def add_days(t):
    return t.orders.select("o_orderkey", F.date_add("o_orderdate", 15).alias("plus15"), F.date_add("o_orderdate", 1).alias("next"),
                           d.styled(F.date_add(F.lit("2024-05-23").cast("date"), 30), 103).alias("available"))


@query("date_format_styles", """
    select event_id, strftime(ts, '%d/%m/%Y') as s103, strftime(ts, '%d-%m-%Y') as s105, strftime(ts, '%Y-%m-%d %H:%M:%S') as s120,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') as s127, strftime(ts, '%H:%M:%S') as s14, strftime(ts, '%A, %B %d %Y at %I:%M %p') as long from events""")
def date_format_styles(t):
    return t.events.select("event_id", *[d.styled(c("ts"), s).alias(f"s{s}") for s in (103, 105, 120, 127, 14)],
                           F.date_format("ts", "EEEE, MMMM dd yyyy 'at' hh:mm a").alias("long"))


@query("parse_dates", """
    select o_orderkey, case when o_orderstatus = 'F' then null else o_orderdate end as iso, o_orderdate as british from orders""")
def parse_dates(t):
    iso = F.when(c("o_orderstatus") == "F", "not a date").otherwise(d.styled(c("o_orderdate"), 126))
    return t.orders.select("o_orderkey", d.parsed(iso, 126).alias("iso"), d.parsed(d.styled(c("o_orderdate"), 103), 103).alias("british"))


@query("days_between", """
    select l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) as days, date_diff('day', o_orderdate, l_shipdate) > 0 as late
    from lineitem join orders on l_orderkey = o_orderkey""")
def days_between(t):
    both = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate").cast("bigint")
    return both.select("l_orderkey", "l_linenumber", "l_partkey", days.alias("days"), (days > 0).alias("late"))


@query("weekday_shift", """
    with w as (select o_orderkey, o_orderdate as x, dayofweek(o_orderdate) as n, o_orderstatus = 'F' as plain from orders)
    select o_orderkey, case when plain then strftime(x, '%Y-%m-%d') else strftime(x + to_days(case n when 6 then 3 when 4 then 4 when 5 then 4 else 2 end), '%d-%m-%Y') end as survey,
           case when plain then strftime(x, '%Y-%m-%d') else strftime(x + to_days(case n when 6 then 2 when 5 then 3 else 1 end), '%d-%m-%Y') end as commitment from w""")
def weekday_shift(t):
    text = F.when(c("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(d.styled(c("o_orderdate"), 126))
    return t.orders.select("o_orderkey", d.shifted_text(text, d.SURVEY_SHIFT).alias("survey"),
                           d.shifted_text(text, d.COMMITMENT_SHIFT).alias("commitment"))


@query("add_working_days", "with" + CALENDAR_SQL + """
    select o_orderkey, e.day as due from orders join num s on cast(o_orderdate as date) = s.day
    join num e on e.is_open and e.open_no = s.open_no + case o_orderstatus when 'O' then 14 when 'P' then 3 else 10 end""")
def add_working_days(t):
    n = F.when(c("o_orderstatus") == "O", 14).when(c("o_orderstatus") == "P", 3).otherwise(10)
    return t.orders.select("o_orderkey", d.working_day_after(c("o_orderdate").cast("date"), n, closed_days(t)).alias("due"))


@query("next_open_day", "with" + CALENDAR_SQL + """,
    nxt as (select day, min(case when is_open then day end) over (order by day rows between 1 following and unbounded following) as next_day from num)
    select o_orderkey, next_day from orders join nxt on cast(o_orderdate as date) = day""")
def next_open_day(t):
    return t.orders.select("o_orderkey", d.open_day_after(c("o_orderdate").cast("date"), closed_days(t)).alias("next_day"))


@query("reshape_date", "select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as day from orders")
def reshape_date(t):
    return t.orders.select("o_orderkey", d.styled(F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")), 103).alias("day"))


@query("date_parts", """
    select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month, case when dayofweek(o_orderdate) in (0, 6) then 'Weekend' else 'Weekday' end as kind,
           case dayofweek(o_orderdate) when 6 then 4 when 0 then 0 else 8 end as hours from orders""")
def date_parts(t):
    day = F.dayofweek("o_orderdate")
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
                           F.when(day.isin(1, 7), "Weekend").otherwise("Weekday").alias("kind"),
                           F.when(day == 7, 4).when(day == 1, 0).otherwise(8).alias("hours"))


@query("snowflake_time", "select event_id, make_timestamp((event_id * 60000 + 1288834974657) * 1000) as at_time from events")
def snowflake_time(t):
    made = F.shiftleft(c("event_id") * 60000, 22) + (c("user_id") % 4096)
    return t.events.select("event_id", d.from_time_id(made).alias("at_time"))
