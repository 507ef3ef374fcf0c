"""Bars from ticks or finer bars: sub-day buckets, calendar periods, bar counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import PERIODS, SECONDS, at_time, bucket_end, local, period_key, session_cut
from ..functions.windows import BY, position
from ..sources.schema import FIELDS
from .stretches import numbered


def bar_aggregates(ts: str = "ts", tie: Sequence[str] = (), extra: Sequence[str] = ()) -> list[Column]:
    """first open, max high, min low, last close, summed volume and amount, last time and extras.

    One hash aggregate with map-side combining; ``tie`` orders rows of one time.
    """
    at = F.struct(ts, *tie)
    return [
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.max(ts).alias("last_ts"), *[F.max_by(c, at).alias(c) for c in extra],
    ]


def resample(
    df: DataFrame, unit: str = "minutes", compression: int = 1, *, by: Sequence[str] = BY, ts: str = "ts", tie: Sequence[str] = (), extra: Sequence[str] = (), to_edge: bool = True, right_edge: bool = True,
    offset: int = 0, session_end: str | None = None, zone: str = "UTC",
) -> DataFrame:
    """Bars of ``compression`` seconds, minutes or hours, or of days, weeks, months, years.

    Sub-day buckets are (start, end], counted from local midnight, so a row on
    an edge closes its bar; with ``session_end`` the row at the session's end
    closes the bar and later rows open new ones.  The stamp is the bucket's end
    (``right_edge``), its start, or the last time seen (``to_edge=False``).
    Days to years are stamped with the session's end of the last day seen if
    one is given, else with the last time.  Larger multiples of them are counts
    of finished bars (``compress``).
    """
    at = local(F.col(ts), zone)
    keyed = df.withColumn("_at", at)
    if unit in PERIODS:
        key = period_key(F.col("_at"), unit)
        bars = keyed.groupBy(*by, key.alias("_key")).agg(*bar_aggregates("_at", tie, extra))
        stamp = F.col("last_ts") if session_end is None else at_time(F.to_date("last_ts"), session_end)
    else:
        key = bucket_end(F.col("_at"), unit, compression, offset)
        if session_end is not None:
            key = session_cut(key, F.col("_at"), session_end)
        bars = keyed.groupBy(*by, key.alias("_key")).agg(*bar_aggregates("_at", tie, extra))
        width = SECONDS[unit] * compression * 1_000_000
        edge = F.col("_key") if right_edge else F.timestamp_micros(F.unix_micros("_key") - width)
        stamp = edge if to_edge else F.col("last_ts")
    back = stamp if zone == "UTC" else F.to_utc_timestamp(stamp, zone)
    out = bars.select(*by, back.alias(ts), *FIELDS, *extra)
    return compress(out, compression, by=by, ts=ts, extra=extra) if unit in PERIODS and compression > 1 else out


def calendar_bars(df: DataFrame, closes: DataFrame, *, by: Sequence[str] = BY, ts: str = "ts", tie: Sequence[str] = (), extra: Sequence[str] = (), session_end: str | None = None) -> DataFrame:
    """Bars that end with the days of ``closes`` (day), such as a calendar's last trading days of weeks, months or years.

    A row belongs to the first of those days at or after its own; rows after
    the last one make a bar that is still open.  Stamps as for ``resample``.
    """
    from .align import benchmark_on

    days = df.select(F.to_date(ts).alias("day")).distinct()
    closing = benchmark_on(days, closes.select("day").distinct().withColumn("ret", F.lit(1.0)))
    keyed = df.withColumn("day", F.to_date(ts)).join(closing.select("day", F.col("benchmark_day").alias("_key")), "day")
    bars = keyed.groupBy(*by, "_key").agg(*bar_aggregates(ts, tie, extra))
    stamp = F.col("last_ts") if session_end is None else at_time(F.to_date("last_ts"), session_end)
    return bars.select(*by, stamp.alias(ts), *FIELDS, *extra)


def compress(df: DataFrame, n: int, *, by: Sequence[str] = BY, ts: str = "ts", tie: Sequence[str] = (), extra: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Every ``n`` rows of a series as one bar, stamped with the last; the rest at the end is one too.

    With ``width`` rows are numbered in stretches of that many seconds (``stretches``), so no task holds a series.
    """
    numbers = df.withColumn("_n", position(by, (ts, *tie))) if width is None else numbered(df, "_n", by=by, order=(ts, *tie), width=width)
    bars = numbers.groupBy(*by, F.floor((F.col("_n") - 1) / n).alias("_group")).agg(*bar_aggregates(ts, tie, extra))
    return bars.select(*by, F.col("last_ts").alias(ts), *FIELDS, *extra)


PRESETS = {"seconds": "seconds", "minutes": "minutes", "hours": "hours", "daily": "days", "weekly": "weeks", "monthly": "months", "yearly": "years"}


def preset(df: DataFrame, name: str, compression: int = 1, **options: object) -> DataFrame:
    """A resampler by its usual name; ``ticks`` counts rows."""
    if name == "ticks":
        return compress(df, compression, **options)
    return resample(df, PRESETS[name], compression, **options)


def timeframes(df: DataFrame, frames: Sequence[tuple[str, int]], **options: object) -> dict[tuple[str, int], DataFrame]:
    """The same source at several frames; a sub-day frame is made from a finer one that divides it, not from the source.

    Bars at right edges keep what a coarser bar needs: firsts, lasts, extremes
    and sums.  Options that move stamps off those edges make each frame anew.
    """
    plain = not set(options) - {"by", "tie", "extra"}
    by = tuple(options.get("by", BY))
    out: dict[tuple[str, int], DataFrame] = {}
    for unit, n in sorted(frames, key=lambda f: SECONDS.get(f[0], 10**9) * f[1]):
        width = SECONDS.get(unit, 0) * n
        finer = [f for f in out if width and plain and width % (SECONDS[f[0]] * f[1]) == 0 and 86_400 % (SECONDS[f[0]] * f[1]) == 0]
        if finer:
            out[unit, n] = resample(out[finer[-1]], unit, n, by=by, extra=options.get("extra", ()))
        else:
            out[unit, n] = resample(df, unit, n, **options)
    return {f: out[f] for f in frames}
