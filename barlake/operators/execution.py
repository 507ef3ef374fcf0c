"""Execution analytics: orders against bars, as joins and windows (no event loop)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import BY, series
from .daybook import Day, against_days, ranges
from .steps import CarriedSlice
from .stepwise import stepwise

# Board and lot by symbol prefix.
BOARDS = (("688", 2, 200), ("3", 1, 100), ("4", 3, 100), ("8", 3, 100))
MAIN_BOARD, LOT = 0, 100
# Daily price-limit ratio by board and the date it holds from.
LIMITS = ((2, "1900-01-01", 0.2), (1, "1900-01-01", 0.1), (1, "2020-08-24", 0.2), (3, "1900-01-01", 0.1), (3, "2021-11-15", 0.3), (0, "1900-01-01", 0.1))
# Stock commission rates.
STAMP, TRANSFER, TRADE_OLD, TRADE_NEW, TRADE_CUT = 0.001, 0.0001, 0.003, 0.0005, "2015-06-09"
IMPACT = 0.05
FLAT = 0.01
LEAST_NOTIONAL = 20_000.0
#: Orders whose slices a task works out at once.
_BLOCK = 4096


def board(sid: Column) -> Column:
    out = F.lit(None).cast("int")
    for prefix, code, _ in reversed(BOARDS):
        out = F.when(sid.startswith(prefix), code).otherwise(out)
    return F.coalesce(out, F.lit(MAIN_BOARD))


def lot(sid: Column) -> Column:
    out = F.lit(LOT)
    for prefix, _, size in reversed(BOARDS):
        out = F.when(sid.startswith(prefix), size).otherwise(out)
    return out


def price_limit_ratio(board_code: Column, day: Column) -> Column:
    """The ratio of the newest rule of the board that holds on the day."""
    out = F.lit(None).cast("double")
    for code, since, ratio in sorted(LIMITS, key=lambda r: (r[0], r[1])):
        out = F.when((board_code == code) & (day >= F.lit(since).cast("date")), ratio).otherwise(out)
    return out


def lot_size_buy(cash: Column, price: Column, lot_: Column, ratio: Column) -> Column:
    """Whole lots for a share of the cash; 0 if one lot costs more than all of it."""
    lots = F.floor(F.try_divide(ratio * cash, price * lot_))
    return F.when(price * lot_ > cash, 0).otherwise(lots * lot_).cast("long")


def lot_size_sell(available: Column, ratio: Column) -> Column:
    return F.floor(available * ratio).cast("long")


def reference_price(rule: Column, limit: Column, *, by: Sequence[str] = BY, order: Sequence[str] = ("ts",)) -> Column:
    """(1 + limit) times a field of the bar before: open, close, mean (of four) or high-low (middle)."""
    w = series(by, order)
    o, h, l_, c = (F.lag(x).over(w) for x in ("open", "high", "low", "close"))
    field = F.when(rule == "open", o).when(rule == "close", c).when(rule == "mean", (o + h + l_ + c) / 4).when(rule == "high-low", (h + l_) / 2)
    return (1 + limit) * field


def bars_met(orders: DataFrame, bars: DataFrame, *, by: Sequence[str] = BY, created: str = "created_dt", ts: str = "ts") -> DataFrame:
    """Each order with every bar of its day at or after its time: for what needs all pairs (an equi-join on series and day)."""
    asked = orders.withColumn("_day", F.to_date(created))
    rest = [c for c in bars.columns if c not in (*by, ts)]
    seen = bars.select(*by, F.col(ts).alias("bar_ts"), *[F.col(c).alias(f"bar_{c}") for c in rest]).withColumn("_day", F.to_date("bar_ts"))
    return asked.join(seen, [*by, "_day"]).where(F.col("bar_ts") >= F.col(created)).drop("_day")


def limit_touch(orders: DataFrame, bars: DataFrame, *, by: Sequence[str] = BY, created: str = "created_dt", ts: str = "ts") -> DataFrame:
    """First bar of the order's day that reaches its limit: touch_ts and touch_price (the open if it gapped through).

    Each order looks its bar up by binary search (``daybook``); ``order_id`` is unique.
    """

    def touch(asked: pa.Table, day: Day) -> tuple[np.ndarray, dict]:
        buys = asked["is_buy"].to_numpy(zero_copy_only=False).astype(bool)
        limit, start = asked["pricelimit"].to_numpy().astype(float), day.starts(asked["_us"].to_numpy())
        open_, found = day.column("open"), np.full(len(buys), day.n)
        found[buys] = day.first_at_most(day.column("low"), start[buys], limit[buys])
        found[~buys] = day.first_at_most(-day.column("high"), start[~buys], -limit[~buys])
        at = np.flatnonzero(found < day.n)
        bar = found[at]
        with np.errstate(invalid="ignore"):
            price = np.where(buys[at], np.fmin(open_[bar], limit[at]), np.fmax(open_[bar], limit[at]))
        return at, {"touch_ts": day.table["_ts"].take(pa.array(bar)), "touch_price": price}

    columns = [("touch_ts", bars.schema[ts].dataType), ("touch_price", T.DoubleType())]
    met = against_days(orders, bars, touch, columns, by=by, created=created, ts=ts).select("order_id", "touch_ts", "touch_price")
    return orders.join(met, "order_id", "left").select(*orders.columns, "touch_ts", "touch_price")


def locked_factor(is_buy: Column, low: Column, high: Column, day_low: Column, day_high: Column) -> Column:
    """0 on a bar locked at the day's extreme against the side, range / 0.005 (at most 1) where it touches it, else 1."""
    against = F.when(is_buy, high >= day_high).otherwise(low <= day_low)
    span = F.try_divide(high - low, low)
    return F.when(against & (high == low), 0.0).when(against, F.least(span / 0.005, F.lit(1.0))).otherwise(1.0)


def capped_fills(orders: DataFrame, bars: DataFrame, impact: float = IMPACT, factor: str | None = None, *, by: Sequence[str] = BY, created: str = "created_dt", ts: str = "ts") -> DataFrame:
    """Fills of at most ``impact`` of each bar's volume, earliest bars first, until the size is done.

    Closed form: running sums of the caps say where an order is complete, which
    is a binary search, and a bar takes what is left after the caps before it.
    ``factor`` is a bar column that scales the cap (``locked_factor``).
    """

    def fill(asked: pa.Table, day: Day) -> tuple[np.ndarray, dict]:
        scale = day.column(factor) if factor else 1.0
        cap = np.floor(np.nan_to_num(day.column("volume") * impact * scale)).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(np.maximum(cap, 0))])
        size, start = asked["size"].to_numpy().astype(np.int64), day.starts(asked["_us"].to_numpy())
        last = np.minimum(np.searchsorted(total, total[start] + size, side="left"), day.n)
        order, bar = ranges(start, np.where(size > 0, last, start))
        some = cap[bar] > 0
        order, bar = order[some], bar[some]
        taken = np.minimum(cap[bar], size[order] - (total[bar] - total[start[order]]))
        return order, {"executed_dt": day.table["_ts"].take(pa.array(bar)), "executed_size": taken, "executed_price": day.table["close"].take(pa.array(bar))}

    columns = [("executed_dt", bars.schema[ts].dataType), ("executed_size", T.LongType()), ("executed_price", T.DoubleType())]
    return against_days(orders, bars, fill, columns, by=by, created=created, ts=ts, fields=("close", "volume", *([factor] if factor else [])))


def flat_days(bars: DataFrame, least: float = FLAT, *, by: Sequence[str] = BY, ts: str = "ts") -> DataFrame:
    """(by, day): days on which (max - min) / min is below ``least``; orders there are rejected (an anti join)."""
    days = bars.groupBy(*by, F.to_date(ts).alias("day")).agg(F.max("high").alias("h"), F.min("low").alias("l"))
    return days.where(F.try_divide(F.col("h") - F.col("l"), F.col("l")) < least).select(*by, "day")


def vwap_schedule(orders: DataFrame, bars: DataFrame, lot_size: int = LOT, equal: bool = False, *, by: Sequence[str] = BY, created: str = "created_dt", ts: str = "ts") -> DataFrame:
    """Slices of each order by the bars' share of the volume still to come that day (or equal shares), in lots.

    The cumulative target is cut to lots and differenced, so slices add up; the
    last bar takes what is left.  Targets come from running sums of the day's
    volumes, a block of orders at a time, and only slices leave the task.
    """

    def slices(asked: pa.Table, day: Day) -> tuple[np.ndarray, dict]:
        volume = np.ones(day.n) if equal else np.nan_to_num(day.column("volume"))
        total = np.concatenate([[0.0], np.cumsum(volume)])
        size, start = asked["size"].to_numpy().astype(np.int64), day.starts(asked["_us"].to_numpy())
        found = []
        for a in range(0, len(size), _BLOCK):
            order, bar = ranges(start[a : a + _BLOCK], np.full(len(size[a : a + _BLOCK]), day.n))
            order += a
            whole = total[day.n] - total[start[order]]
            with np.errstate(invalid="ignore", divide="ignore"):
                share = np.where(whole != 0, (total[bar + 1] - total[start[order]]) / whole, 0.0)
            upto = np.where(bar == day.n - 1, size[order], (np.floor(share * size[order] / lot_size) * lot_size).astype(np.int64))
            before = np.concatenate([[0], upto[:-1]])
            step = upto - np.where(bar == start[order], 0, before)
            some = step > 0
            found.append((order[some], bar[some], step[some]))
        order, bar, step = (np.concatenate(x) for x in zip(*found, strict=True))
        return order, {"bar_ts": day.table["_ts"].take(pa.array(bar)), "target": step, "bar_close": day.table["close"].take(pa.array(bar))}

    columns = [("bar_ts", bars.schema[ts].dataType), ("target", T.LongType()), ("bar_close", T.DoubleType())]
    return against_days(orders, bars, slices, columns, by=by, created=created, ts=ts, fields=("close", "volume"))


def twap_schedule(orders: DataFrame, bars: DataFrame, lot_size: int = LOT, **options: object) -> DataFrame:
    """Equal slices over the bars left."""
    return vwap_schedule(orders, bars, lot_size, equal=True, **options)


def carry_small(slices: DataFrame, least: float = LEAST_NOTIONAL, *, tie: Sequence[str]) -> DataFrame:
    """Slices of an order below ``least`` in value accumulate to a later bar; the last bar takes what is left.

    What is carried depends on what was released, so an order's bars go through
    one step at a time, in time order and, of one time, in that of ``tie``.
    """
    backwards = [F.col("bar_ts").desc(), *[F.col(c).desc() for c in tie]]
    last = F.row_number().over(W.partitionBy("order_id").orderBy(*backwards)) == 1
    return stepwise(slices.withColumn("_last", last), lambda: CarriedSlice(least), by=("order_id",), ts="bar_ts", tie=tie)


def slip(price: Column, is_buy: Column, day_low: Column, day_high: Column, percent: float = 0.0, fixed: float = 0.0) -> Column:
    """The price moved against the side, within the day's range."""
    worse = F.when(is_buy, price * (1 + percent) + fixed).otherwise(price * (1 - percent) - fixed)
    return F.greatest(F.least(worse, day_high), day_low)


def stock_commission(size: Column, price: Column, is_buy: Column, day: Column, shanghai: Column) -> Column:
    """Stamp duty on sells, transfer fee on one exchange and the trade fee of the date."""
    trade = F.when(day < F.lit(TRADE_CUT).cast("date"), TRADE_OLD).otherwise(TRADE_NEW)
    rate = F.when(is_buy, 0.0).otherwise(STAMP) + F.when(shanghai, TRANSFER).otherwise(0.0) + trade
    return rate * F.abs(size) * price


def commission(size: Column, price: Column, percent: float | None = None, fixed: float | None = None) -> Column:
    """A percentage of the value, or a fixed amount a unit."""
    return F.abs(size) * price * percent if percent is not None else F.abs(size) * (fixed or 0.0)


def holding_interest(size: Column, price: Column, days: Column, rate: float) -> Column:
    return days * rate / 365 * F.abs(size) * price


def order_status(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Orders with filled and status: completed, partial or open, by the sum of their fills."""
    done = fills.groupBy("order_id").agg(F.sum("executed_size").alias("filled"))
    out = orders.join(done, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return out.withColumn("status", F.when(F.col("filled") >= F.col("size"), "completed").when(F.col("filled") > 0, "partial").otherwise("open"))
