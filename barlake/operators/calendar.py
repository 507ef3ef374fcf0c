"""Trading calendars and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.buckets import at_time, micros_of_day, period_key
from ..functions.windows import BY, series


def trading_days(spark: SparkSession, start: str, end: str, holidays: Sequence[str] = (), off_days: Sequence[int] = (6, 7)) -> DataFrame:
    """(day): dates in start .. end without ISO weekdays ``off_days`` and holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    days = days.where(~(F.weekday("day") + 1).isin(list(off_days))) if off_days else days
    return days.where(~F.col("day").isin([F.lit(h).cast("date") for h in holidays])) if holidays else days


def _all_days() -> W:
    return W.orderBy("day")  # a calendar is a few thousand rows at most


def next_trading_day(days: DataFrame) -> DataFrame:
    """Adds ``next_day``, null for the last."""
    return days.withColumn("next_day", F.lead("day").over(_all_days()))


def sessions(days: DataFrame, open_time: str, close_time: str, early: DataFrame | None = None) -> DataFrame:
    """(day, open_ts, close_ts); ``early`` is (day, open_time, close_time) of shortened days."""
    if early is None:
        return days.select("day", at_time(F.col("day"), open_time).alias("open_ts"), at_time(F.col("day"), close_time).alias("close_ts"))
    hours = days.join(early.select("day", F.col("open_time").alias("_o"), F.col("close_time").alias("_c")), "day", "left")

    def stamp(own: str, usual: str) -> Column:
        return F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.coalesce(own, F.lit(usual))))

    return hours.select("day", stamp("_o", open_time).alias("open_ts"), stamp("_c", close_time).alias("close_ts"))


def session_of(rows: DataFrame, table: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with the session whose close is the first at or after their time (rolls past a day's close).

    Rows before the first session have that one, however long before it they are; rows after the last have none.
    """
    from .align import asof

    values = ["day", "open_ts", "close_ts"]
    table = table.where("close_ts is not null")

    marks = table.select(F.lit(0).alias("_g"), F.col("close_ts").alias(ts), "day", "open_ts", F.col("close_ts").alias("_close"))
    # one calendar for all rows: they are dealt by date, and a mark stands on every date from the last one up to its close
    spread = marks.withColumn("_from", F.to_date(F.coalesce(F.lag(ts).over(W.orderBy(ts)), ts)))
    by_date = spread.select(F.explode(F.sequence("_from", F.to_date(ts))).alias("_date"), ts, "day", "open_ts", F.col("_close").alias("close_ts"))
    found = asof(rows.withColumn("_date", F.to_date(ts)), by_date, values, by=("_date",), ts=ts, forward=True).drop("_date")
    # the first session is one row beside all others
    found = found.crossJoin(F.broadcast(table.agg(F.min(F.struct("close_ts", "day", "open_ts")).alias("_first"))))
    early = F.col(ts) <= F.col("_first.close_ts")
    return found.select(*[c for c in rows.columns if c not in values], *[F.when(early, F.col(f"_first.{v}")).otherwise(F.col(v)).alias(v) for v in values])


def period_closes(days: DataFrame) -> DataFrame:
    """Adds whether a day is the last trading day of its week, month and year, and the next day's ISO week."""
    nxt = F.lead("day").over(_all_days())
    last = {f"last_of_{u}": F.coalesce(period_key(nxt, f"{u}s") != period_key(F.col("day"), f"{u}s"), F.lit(True)) for u in ("week", "month", "year")}
    return days.select("day", *[c.alias(k) for k, c in last.items()], F.weekofyear(nxt).alias("next_week"))


def session_breaks(df: DataFrame, hours: float = 12.0, *, by: Sequence[str] = BY, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Numbers sessions of a series: a gap of at least ``hours`` starts a new one."""
    w = series(by, (ts, *tie))
    gap = F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)
    new = F.when(gap.isNull() | (gap >= int(hours * 3600 * 1_000_000)), 1).otherwise(0)
    marked = df.withColumn("_new", new)
    return marked.withColumn("session_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def schedule(bars: DataFrame, when: str, *, offset: int = 0, repeat: int | None = None, until: str = "23:59:59", by: Sequence[str] = BY, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The bars on which a timer fires: each day the first at or after ``when`` + ``offset`` seconds.

    With ``repeat`` seconds also the first of every further slot up to
    ``until``; a slot without a bar is skipped, not queued.
    """
    h, m, s = (int(x) for x in when.split(":"))
    start = (h * 3600 + m * 60 + s + offset) * 1_000_000
    h, m, s = (int(x) for x in until.split(":"))
    end = (h * 3600 + m * 60 + s) * 1_000_000
    passed = micros_of_day(F.col(ts)) - start
    slot = F.floor(passed / (repeat * 1_000_000)) if repeat else F.lit(0)
    due = bars.withColumns({"_slot": slot, "_day": F.to_date(ts)}).where((passed >= 0) & (micros_of_day(F.col(ts)) <= end))
    first = F.row_number().over(W.partitionBy(*by, "_day", "_slot").orderBy(ts, *tie))
    return due.withColumn("_k", first).where("_k = 1").drop("_slot", "_day", "_k")


def restricted_days(days: DataFrame, weekdays: Sequence[int] = (), month_days: Sequence[int] = (), carry: bool = True) -> DataFrame:
    """(target, day): calendar dates wanted by ISO weekday or day of month and the trading day they fall on.

    A date that is no trading day moves to the next one if ``carry``, else it is left out.
    """
    bounds = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    dates = bounds.select(F.explode(F.sequence("a", "b")).alias("target"))
    wanted = F.lit(False)
    if weekdays:
        wanted = wanted | (F.weekday("target") + 1).isin(list(weekdays))
    if month_days:
        wanted = wanted | F.dayofmonth("target").isin(list(month_days))
    both = dates.join(days.select(F.col("day").alias("target"), "day"), "target", "left")
    nxt = F.first("day", True).over(W.orderBy("target").rowsBetween(0, W.unboundedFollowing))
    moved = both.select("target", (nxt if carry else F.col("day")).alias("day"))
    return moved.where(wanted & F.col("day").isNotNull())


def allowed(days: DataFrame, predicate: Column) -> DataFrame:
    """Dates for which a condition is true."""
    return days.where(predicate)
