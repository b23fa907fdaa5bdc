"""Dates: text styles, weekday rules and working days."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.operators.bins import whole_up_to

# Date text styles by number, as Spark patterns.
STYLES = {
    14: "HH:mm:ss",
    103: "dd/MM/yyyy",
    105: "dd-MM-yyyy",
    120: "yyyy-MM-dd HH:mm:ss",
    126: "yyyy-MM-dd'T'HH:mm:ss",
    127: "yyyy-MM-dd'T'HH:mm:ss",
}

# Days to add by day of week (1 = Sunday ... 7 = Saturday).
SURVEY_SHIFT = {7: 3, 1: 2, 2: 2, 3: 2, 4: 2, 5: 4, 6: 4}
COMMITMENT_SHIFT = {7: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 3}

#: Days of a calendar at most; it is made in the driver and broadcast.
MOST_DAYS = 200 * 366


def styled(value: Column, style: int) -> Column:
    return F.date_format(value, STYLES[style])


def parsed(text: Column, style: int) -> Column:
    """Text in a style as a time without zone; null where it does not fit."""
    return F.try_to_timestamp(text, F.lit(STYLES[style])).cast("timestamp_ntz")


def weekday_shift(value: Column, rules: Mapping[int, int]) -> Column:
    """Add the days that the rule table gives for the day of the week."""
    days = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.dayofweek(value)]
    return F.date_add(value, days)


def shifted_text(text: Column, rules: Mapping[int, int]) -> Column:
    """A time text (with T) shifted by the rules as dd-MM-yyyy; any other text unchanged."""
    day = F.to_date(parsed(text, 126))
    return F.when(text.contains("T"), F.date_format(weekday_shift(day, rules), STYLES[105])).otherwise(text)


def calendar_days(first: datetime.date, last: datetime.date, holidays: Iterable[datetime.date] = ()) -> list[tuple]:
    """``(day, is_open, open_no, next_open_day)`` for each day of a range of at most 200 years."""
    if (last - first).days > MOST_DAYS:
        raise ValueError(f"a calendar from {first} to {last}: is there a stray date?")
    closed = set(holidays)
    days = [first + datetime.timedelta(i) for i in range((last - first).days + 1)]
    is_open = [d.weekday() < 5 and d not in closed for d in days]
    following, next_open = None, []
    for day, open_ in zip(reversed(days), reversed(is_open)):
        next_open.append(following)
        following = day if open_ else following
    count, rows = 0, []
    for day, open_, after in zip(days, is_open, reversed(next_open)):
        count += open_
        rows.append((day, open_, count, after))
    return rows


def _weekday_no(day: datetime.date) -> int:
    """Mondays to Fridays up to and including the day, counted from Monday, 1969-12-29."""
    at = day.toordinal() - datetime.date(1969, 12, 29).toordinal()
    return at // 7 * 5 + min(at % 7 + 1, 5)


def working_day_after(day: Column, n: Column | int, holidays: Iterable[datetime.date] = ()) -> Column:
    """The open day ``n`` open days after ``day`` (n = 0: the last one up to it). Open days are Monday to Friday without the holidays.

    Arithmetic on weeks, with the holidays as a sorted list that is searched: there is no calendar to join and no range to leave. Null gives null.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    closed = sorted({h for h in holidays if h.weekday() < 5})
    number = F.unix_date(day)
    at = number + 3  # from a Monday
    open_no = F.floor(at / 7) * 5 + F.least(F.pmod(at, F.lit(7)) + 1, F.lit(5)) + n
    if closed:
        epoch = datetime.date(1970, 1, 1).toordinal()
        # a holiday is passed if the open days before it do not reach the wanted one
        before = [_weekday_no(h) - k for k, h in enumerate(closed, 1)]
        wanted = open_no - whole_up_to(number, [h.toordinal() - epoch for h in closed])
        # (an array of one, so that what is used several times is computed once)
        open_no = F.transform(F.array(wanted), lambda w: w + whole_up_to(w - 1, before))
    else:
        open_no = F.array(open_no)
    place = F.transform(open_no, lambda o: F.floor((o - 1) / 5) * 7 + F.pmod(o - 1, F.lit(5)) - 3)
    return F.date_from_unix_date(F.get(place, 0).cast("int"))


def open_day_after(day: Column, holidays: Iterable[datetime.date] = ()) -> Column:
    """The first open day after ``day``."""
    return working_day_after(day, 1, holidays)


def from_time_id(value: Column, epoch_ms: int = 1288834974657) -> Column:
    """The time inside an id whose bits above 22 count milliseconds."""
    return F.timestamp_millis(F.shiftright(value, 22) + F.lit(epoch_ms)).cast("timestamp_ntz")
