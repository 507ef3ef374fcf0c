"""Performance of equity curves (experiment_id, day, value), of closed positions, orders and trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import expanding, position, series, trailing
from .stretches import running

BY, ORDER = ("experiment_id",), ("day",)
#: Periods a year.
FACTORS = {"days": 252, "weeks": 52, "months": 12, "years": 1}


def time_return(equity: DataFrame, unit: str = "days", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds ret, cum_ret and ann_ret = (1 + cum)^(periods a year / periods so far) - 1."""
    w = series(by, order)
    first = F.first("value").over(expanding(by, order))
    out = equity.withColumns({"ret": F.try_divide(F.col("value"), F.lag("value").over(w)) - 1, "cum_ret": F.try_divide(F.col("value"), first) - 1, "_t": position(by, order)})
    return out.withColumn("ann_ret", F.pow(1 + F.col("cum_ret"), FACTORS[unit] / F.col("_t")) - 1).drop("_t")


def drawdown(equity: DataFrame, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: int | None = None) -> DataFrame:
    """Adds peak, drawdown (share of the peak), dd_len (rows since the peak) and the largest of both so far.

    With ``width`` values run in stretches of that many seconds (``stretches``), so no task holds a series.
    """

    def ran(rows: DataFrame, values: dict[str, tuple[str, Column]]) -> DataFrame:
        if width is not None:
            return running(rows, values, by=by, order=order, width=width)
        w = expanding(by, order)
        over = {"max": lambda x: F.max(x).over(w), "count": lambda x: F.count(x).over(w), "last": lambda x: F.last(x, True).over(w)}
        return rows.withColumns({name: over[kind](x) for name, (kind, x) in values.items()})

    rows = ran(equity, {"peak": ("max", F.col("value")), "_n": ("count", F.lit(1))})
    rows = rows.withColumn("drawdown", F.try_divide(F.col("peak") - F.col("value"), F.col("peak")))
    rows = ran(rows, {"_at": ("last", F.when(F.col("value") == F.col("peak"), F.col("_n"))), "max_drawdown": ("max", F.col("drawdown"))})
    rows = rows.withColumn("dd_len", F.col("_n") - F.col("_at"))
    return ran(rows, {"max_dd_len": ("max", F.col("dd_len"))}).drop("_n", "_at")


def calmar(equity: DataFrame, unit: str = "days", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds calmar = ann_ret / max_drawdown, 0 without a drawdown."""
    rows = drawdown(time_return(equity, unit, by=by, order=order), by=by, order=order)
    return rows.withColumn("calmar", F.coalesce(F.try_divide(F.col("ann_ret"), F.col("max_drawdown")), F.lit(0.0)))


def calmar_log(equity: DataFrame, n: int = 36, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds calmar_log = ln(value / first of the last n) / rows / max drawdown, 0 without a drawdown."""
    w = trailing(n, by, order)
    rows = drawdown(equity, by=by, order=order)
    rows = rows.withColumns({"_first": F.first("value").over(w), "_len": F.count("*").over(w)})
    rate = F.ln(F.try_divide(F.col("value"), F.col("_first"))) / F.col("_len")
    return rows.withColumn("calmar_log", F.coalesce(F.try_divide(rate, F.col("max_drawdown")), F.lit(0.0))).drop("_first", "_len")


def sharpe(returns: DataFrame, ret: str = "ret", risk_free: float = 0.01, unit: str = "days", annualise: bool = True, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds sharpe: mean over sample deviation of the excess return so far; null for fewer than two or equal returns."""
    periods = FACTORS[unit]
    w = expanding(by, order)
    rows = returns.withColumn("_e", F.col(ret) - ((1 + risk_free) ** (1 / periods) - 1))
    sd = F.stddev_samp("_e").over(w)
    value = F.avg("_e").over(w) / F.col("_sd") * (periods**0.5 if annualise else 1.0)
    return rows.withColumn("_sd", sd).withColumn("sharpe", F.when((F.count("_e").over(w) > 1) & (F.col("_sd") > 1e-12), value)).drop("_e", "_sd")


def period_stats(returns: DataFrame, ret: str = "ret", zero_is_positive: bool = False, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds average, stddev (population), positive, negative, nochange, best and worst so far."""
    w, r = expanding(by, order), F.col(ret)

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)).over(w), F.lit(0))

    positive = r >= 0 if zero_is_positive else r > 0
    return returns.withColumns(
        {"average": F.avg(r).over(w), "stddev": F.stddev_pop(r).over(w), "positive": count(positive), "negative": count(r < 0), "nochange": count((r == 0) & F.lit(not zero_is_positive)), "best": F.max(r).over(w), "worst": F.min(r).over(w)}
    )


def closed_positions(fills: DataFrame, *, by: Sequence[str] = ("experiment_id", "sid"), order: Sequence[str] = ("executed_dt", "order_id")) -> DataFrame:
    """One row each time a position goes flat: opened, closed, days, trades and net pnl after commission.

    A series' fills are cut into rounds, each of which ends where the running size is 0.
    """
    q = F.when(F.col("is_buy"), F.col("executed_size")).otherwise(-F.col("executed_size"))
    rows = fills.withColumns({"_q": q, "_cash": -q * F.col("executed_price") - F.coalesce("comm", F.lit(0.0))})
    rows = rows.withColumn("_size", F.sum("_q").over(expanding(by, order)))
    flat = F.when(F.col("_size") == 0, 1).otherwise(0)
    rows = rows.withColumn("_flat", flat)
    rows = rows.withColumn("round", F.coalesce(F.sum("_flat").over(series(by, order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rounds = rows.groupBy(*by, "round").agg(
        F.min(order[0]).alias("opened"), F.max(order[0]).alias("closed"), F.count("*").alias("trades"), F.sum("_cash").alias("pnl"), F.max("_flat").alias("_done")
    )
    return rounds.where("_done = 1").drop("_done").withColumn("days", F.date_diff(F.to_date("closed"), F.to_date("opened")))


def closed_stats(closed: DataFrame, *, by: Sequence[str] = ("experiment_id",)) -> DataFrame:
    """By day of closing: win rate of the day and so far, average holding days and net pnl so far, number closed."""
    per = closed.groupBy(*by, F.to_date("closed").alias("day")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("pnl") > 0, 1).otherwise(0)).alias("wins"), F.sum("days").alias("_days"), F.sum("pnl").alias("pnl"))
    w = expanding(by, ("day",))
    return per.select(
        *by, "day", "n", "pnl", F.try_divide("wins", "n").alias("win_rate"), F.try_divide(F.sum("wins").over(w), F.sum("n").over(w)).alias("cum_win_rate"),
        F.try_divide(F.sum("_days").over(w), F.sum("n").over(w)).alias("avg_days"), F.sum("pnl").over(w).alias("cum_pnl"), F.sum("n").over(w).alias("cum_n"),
    )


def sqn(closed: DataFrame, *, by: Sequence[str] = ("experiment_id",), order: Sequence[str] = ("closed", "sid", "round")) -> DataFrame:
    """Adds sqn = sqrt(n) mean(pnl) / sample deviation over the positions closed so far."""
    w = expanding(by, order)
    return closed.withColumn("sqn", F.try_divide(F.sqrt(F.count("pnl").over(w).cast("double")) * F.avg("pnl").over(w), F.stddev_samp("pnl").over(w)))


def order_counts(orders: DataFrame, minutes: int | None = None, *, by: Sequence[str] = ("experiment_id",), ts: str = "created_dt") -> DataFrame:
    """Orders by day, or by interval of a day."""
    keys = [F.to_date(ts).alias("day")]
    if minutes:
        keys.append(F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).alias("slot"))
    return orders.groupBy(*by, *keys).agg(F.count("*").alias("n_orders"))


def running_trades(fills: DataFrame, *, by: Sequence[str] = ("experiment_id",), order: Sequence[str] = ("executed_dt", "order_id")) -> DataFrame:
    """Adds n_trades: fills of the day so far."""
    rows = fills.withColumn("day", F.to_date(order[0]))
    return rows.withColumn("n_trades", F.count("*").over(expanding((*by, "day"), order)))


def portfolio_export(accounts: DataFrame, ts: str = "day", by: Sequence[str] = BY) -> DataFrame:
    """portfolio_value, cash and pnl as a metric log."""
    from ..sources.sinks import metric_log

    return metric_log(accounts, ["portfolio_value", "cash", "pnl"], ids=(*by, ts))


def benchmark_returns(closes: DataFrame, *, day: str = "day") -> DataFrame:
    """(day, ret): change of one close a day, 0 on the first."""
    return closes.select(day, F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(W.orderBy(day))) - 1, F.lit(0.0)).alias("ret"))


def moments(df: DataFrame, x: str, by: Sequence[str] = BY, bessel: bool = False) -> DataFrame:
    """Mean, variance and deviation, with n - 1 if ``bessel``."""
    var, sd = (F.var_samp, F.stddev_samp) if bessel else (F.var_pop, F.stddev_pop)
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), var(x).alias("variance"), sd(x).alias("deviation"))


def buy_and_hold(bars: DataFrame, start: float = 1.0, x: str = "close", name: str = "buy_and_hold", *, by: Sequence[str] = ("sid",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """What ``start`` put into the first bar has become."""
    return bars.withColumn(name, start * F.try_divide(F.col(x), F.first(x, True).over(expanding(by, order))))
