"""Filters, gap fillers and splitters of bars."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import at_time, in_session
from ..functions.windows import BY, series
from ..sources.schema import PRICES
from .scan import affine_scan
from .spans import SpanRenko, in_spans
from .steps import Renko
from .stepwise import stepwise
from .stretches import running


def session_filter(bars: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows whose time of day lies in start .. end."""
    return bars.where(in_session(F.col(ts), start, end))


def where_true(bars: DataFrame, predicate: Column | Callable, columns: Sequence[str] = ()) -> DataFrame:
    """Rows for which a Column, or a function of pandas Series, is true."""
    if isinstance(predicate, Column):
        return bars.where(predicate)
    return bars.where(F.pandas_udf(predicate, T.BooleanType())(*[F.col(c) for c in columns]))


def session_fill(
    bars: DataFrame, seconds: int, start: str, end: str, *, by: Sequence[str] = BY, ts: str = "ts", fill_price: float | None = None, fill_volume: float | None = None, skip_first_fill: bool = True,
    to_end: bool = True, include_end: bool = True,
) -> DataFrame:
    """One bar per missing unit inside the session of every day that a series has.

    Added bars (``is_filled``) have the given price or the previous close, and
    the given volume or null.  Filling starts at the session's start, on a
    series' first day at its first bar if ``skip_first_fill``; it ends at the
    session's end, or at the day's last bar on a series' last day.  Rows off
    the grid or outside the session stay.
    """
    day = F.to_date(ts)
    days = bars.groupBy(*by, day.alias("_day")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    over = W.partitionBy(*by)
    days = days.withColumns({"_is_first": F.col("_day") == F.min("_day").over(over), "_is_last": F.col("_day") == F.max("_day").over(over)})
    open_, close = at_time(F.col("_day"), start), at_time(F.col("_day"), end)
    low = F.when(F.col("_is_first") & F.lit(skip_first_fill), F.greatest(open_, "_first")).otherwise(open_)
    stop = close if include_end else F.timestamp_micros(F.unix_micros(close) - seconds * 1_000_000)
    high = F.when(F.col("_is_last") | F.lit(not to_end), F.least(stop, "_last")).otherwise(stop)
    width = seconds * 1_000_000
    begin, n = F.unix_micros(open_), F.floor((F.unix_micros(high) - F.unix_micros(open_)) / width)
    first = F.ceil((F.unix_micros(low) - begin) / width)
    slots = days.where(n >= first).select(*by, F.explode(F.transform(F.sequence(first, n), lambda i: F.timestamp_micros(begin + i * width))).alias(ts))
    missing = slots.join(bars.select(*by, ts), [*by, ts], "left_anti")
    both = bars.withColumn("is_filled", F.lit(False)).unionByName(missing.withColumn("is_filled", F.lit(True)), allowMissingColumns=True)
    return _filled(both, by, ts, fill_price, fill_volume)


def _filled(both: DataFrame, by: Sequence[str], ts: str, fill_price: float | None, fill_volume: float | None) -> DataFrame:
    w = W.partitionBy(*by).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    price = F.last("close", True).over(w) if fill_price is None else F.lit(fill_price)
    carried = both.withColumn("_price", price)
    values = {p: F.when(F.col("is_filled"), F.col("_price")).otherwise(F.col(p)) for p in PRICES}
    return carried.withColumns({**values, "volume": F.when(F.col("is_filled"), F.lit(fill_volume)).otherwise(F.col("volume"))}).drop("_price")


def gap_fill(bars: DataFrame, seconds: int, start: str, end: str, **options: object) -> DataFrame:
    """As ``session_fill``, but a new day is filled from the session's start even if it is the first and never at its end."""
    return session_fill(bars, seconds, start, end, skip_first_fill=False, include_end=False, **options)


def calendar_fill(bars: DataFrame, *, by: Sequence[str] = BY, ts: str = "ts", fill_price: float | None = None, fill_volume: float | None = None, weekdays_only: bool = False) -> DataFrame:
    """One bar per missing calendar day (or Monday to Friday) between a series' bars.

    ``fill_price``: a positive price, None for the last close, -1 for the
    middle of the last bar's high and low.
    """
    following = F.lead(F.to_date(ts)).over(series(by, (ts,)))
    gaps = bars.select(*by, F.col(ts).alias("_ts"), F.to_date(ts).alias("_day"), following.alias("_next")).where("_next > date_add(_day, 1)")
    days = gaps.select(*by, F.explode(F.sequence(F.date_add("_day", 1), F.date_sub("_next", 1))).alias("_d"), "_ts")
    if weekdays_only:
        days = days.where(~F.dayofweek("_d").isin(1, 7))
    stamp = F.timestamp_micros(F.unix_micros(F.col("_d").cast("timestamp")) + F.unix_micros("_ts") - F.unix_micros(F.date_trunc("day", F.col("_ts"))))
    new = days.select(*by, stamp.alias(ts), F.lit(True).alias("is_filled"))
    both = bars.withColumn("is_filled", F.lit(False)).unionByName(new, allowMissingColumns=True)
    if fill_price == -1:
        w = W.partitionBy(*by).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
        middle = F.last(F.when(~F.col("is_filled"), (F.col("high") + F.col("low")) / 2), True).over(w)
        both = both.withColumn("_m", middle).withColumns({p: F.when(F.col("is_filled"), F.col("_m")).otherwise(F.col(p)) for p in PRICES}).drop("_m")
        return both.withColumn("volume", F.when(F.col("is_filled"), F.lit(fill_volume)).otherwise(F.col("volume")))
    return _filled(both, by, ts, fill_price, fill_volume)


def weekday_fill(bars: DataFrame, fill_close: bool = False, **options: object) -> DataFrame:
    """Missing Mondays to Fridays, as bars without prices or with the last close."""
    filled = calendar_fill(bars, weekdays_only=True, **options)
    return filled if fill_close else filled.withColumns({p: F.when(~F.col("is_filled"), F.col(p)) for p in PRICES})


def _parts(bars: DataFrame, parts: Sequence[dict[str, Column]], ts: str) -> DataFrame:
    rest = [c for c in bars.columns if c not in (*PRICES, "volume", ts)]
    structs = [F.struct(F.lit(i).alias("part"), p[ts].alias(ts), *[p[c].cast("double").alias(c) for c in (*PRICES, "volume")]) for i, p in enumerate(parts)]
    return bars.select(*rest, F.explode(F.array(*structs)).alias("_p")).select(*rest, "_p.*")


def split_day(bars: DataFrame, close_volume: float = 0.5, start: str = "09:00:00", end: str = "17:30:00", ts: str = "ts") -> DataFrame:
    """A day bar as an open part with the mean of open, high, low as close, and a close part."""
    day, v = F.to_date(ts), F.floor(F.col("volume") * (1 - close_volume))
    c = F.col("close")
    head = {"open": F.col("open"), "high": F.col("high"), "low": F.col("low"), "close": (F.col("open") + F.col("high") + F.col("low")) / 3, "volume": v, ts: at_time(day, start)}
    return _parts(bars, [head, dict.fromkeys(PRICES, c) | {"volume": F.col("volume") - v, ts: at_time(day, end)}], ts)


def _whole(ts: Column, name: str) -> dict[str, Column]:
    return {c: F.col(c) for c in (*PRICES, "volume")} | {name: ts}


def open_then_full(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """A bar as its open alone, without volume, and then whole."""
    return _parts(bars, [dict.fromkeys(PRICES, F.col("open")) | {"volume": F.lit(0.0), ts: F.col(ts)}, _whole(F.col(ts), ts)], ts)


def ohl_then_close(bars: DataFrame, close_volume: float = 0.5, start: str = "09:00:00", end: str = "17:30:00", ts: str = "ts") -> DataFrame:
    """A bar without its close (and part of its volume) at the session's start, and whole at its end."""
    day = F.to_date(ts)
    head = {"open": F.col("open"), "high": F.col("high"), "low": F.col("low"), "close": F.col("open"), "volume": F.floor(F.col("volume") * (1 - close_volume)), ts: at_time(day, start)}
    return _parts(bars, [head, _whole(at_time(day, end), ts)], ts)


def heikin_ashi(bars: DataFrame, *, by: Sequence[str] = BY, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Bars with averaged prices: the close is the mean of four, the open the middle of the last averaged bar."""
    w = series(by, order)
    close = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    first = F.row_number().over(w) == 1
    rows = bars.withColumn("ha_close", close)
    rows = rows.withColumns({"_a": F.when(first, 0.0).otherwise(0.5), "_b": F.when(first, (F.col("open") + F.col("close")) / 2).otherwise(F.lag("ha_close").over(w) / 2)})
    out = affine_scan(rows, F.col("_a"), F.col("_b"), "ha_open", by=by, order=order).drop("_a", "_b")
    return out.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")})


def renko(
    bars: DataFrame, *, tie: Sequence[str], by: Sequence[str] = BY, ts: str = "ts", size: float | None = None, autosize: float = 20.0, align: float = 1.0, hilo: bool = False, dynamic: bool = False,
    round_start: bool = True, width: int | None = None,
) -> DataFrame:
    """Bricks of a fixed size (or the first open / ``autosize``): at most one a bar, volume 0, other bars dropped.

    Prices lie on a ladder of levels one size apart around the first open.  The
    band of a series is a rung of it; a price at or beyond the band's upper
    level moves the band up by one and draws the new rung upwards, one at or
    below its lower level moves it down and draws downwards.  Before the first
    brick the band is two rungs wide.  With ``dynamic`` a brick's size follows
    its price.  A bar without close, or before the first open, draws nothing.
    Bars of one time are taken in the order of ``tie``, whose columns stay in
    the result; it is empty where a series has one bar a time.  With ``width``
    (seconds, ``spans``) a series is spread over tasks; bricks of dynamic size
    can't be.
    """
    if width is not None:
        if dynamic:
            raise ValueError("bricks of dynamic size need a series in one task")
        open_ = F.when(F.col("close").isNotNull() & ~F.isnan("close") & ~F.isnan("open"), F.col("open"))
        rows = running(bars, {"_open": ("first", open_)}, by=by, order=(ts, *tie), width=width)
        return in_spans(rows, lambda: SpanRenko(size, autosize, align, hilo, False, round_start), by=by, ts=ts, tie=tie, width=width)
    return stepwise(bars, lambda: Renko(size, autosize, align, hilo, dynamic, round_start), by=by, ts=ts, tie=tie)


def apply_filters(bars: DataFrame, filters: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User filters one after another."""
    return reduce(lambda df, f: df.transform(f), filters, bars)
