"""Period keys and labels: right-closed sub-day buckets, days to years, sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the sub-day units.
SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600}
PERIODS = ("days", "weeks", "months", "years")
SESSION_OPEN, SESSION_CLOSE = "09:30:00", "15:00:00"


def local(ts: Column, zone: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` of a UTC time."""
    return ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)


def micros_of_day(ts: Column) -> Column:
    return F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))


def at_time(day: Column, time: str) -> Column:
    """The timestamp of HH:MM:SS on a day."""
    h, m, s = (int(x) for x in time.split(":"))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + (h * 3600 + m * 60 + s) * 1_000_000)


def bucket_end(ts: Column, unit: str, compression: int = 1, offset: int = 0) -> Column:
    """End of the (start, end] bucket of ``compression`` units, counted from local midnight.

    A row exactly on an edge belongs to the bucket that the edge closes.
    ``offset`` seconds move rows before they are put into buckets.
    """
    width = SECONDS[unit] * compression * 1_000_000
    n = F.ceil((micros_of_day(ts) + offset * 1_000_000) / width)
    return F.timestamp_micros(F.unix_micros(F.date_trunc("day", ts)) + n.cast("long") * width)


def session_cut(end: Column, ts: Column, close: str = SESSION_CLOSE) -> Column:
    """A bucket's end, not beyond the session's end for rows up to it."""
    stop = at_time(F.to_date(ts), close)
    return F.when(ts <= stop, F.least(end, stop)).otherwise(end)


def period_key(ts: Column, unit: str) -> Column:
    """First day of the day, ISO week, month or year."""
    return F.to_date(F.date_trunc({"days": "day", "weeks": "week", "months": "month", "years": "year"}[unit], ts))


def period_end(ts: Column, unit: str, compression: int = 1) -> Column:
    """The last second of the period: 23:59:59 of its last day, or the end of a sub-day bucket less a second."""
    day = F.to_date(ts)
    if unit == "days":
        last = day
    elif unit == "weeks":
        last = F.date_add(F.to_date(F.date_trunc("week", ts)), 6)
    elif unit == "months":
        last = F.last_day(day)
    elif unit == "years":
        last = F.make_date(F.year(day), F.lit(12), F.lit(31))
    else:
        width = SECONDS[unit] * compression * 1_000_000
        n = F.floor(micros_of_day(ts) / width) + 1
        return F.timestamp_micros(F.unix_micros(F.date_trunc("day", ts)) + n * width - 1_000_000)
    return at_time(last, "23:59:59")


def in_session(ts: Column, start: str, end: str) -> Column:
    """Whether the time of day lies in start .. end, both included."""
    time = F.date_format(ts, "HH:mm:ss.SSSSSS")
    return (time >= f"{start}.000000") & (time <= f"{end}.000000")


def market_open(day: Column, open_time: str = SESSION_OPEN) -> Column:
    return at_time(day, open_time)


def market_close(day: Column, close_time: str = SESSION_CLOSE) -> Column:
    return at_time(day, close_time)
