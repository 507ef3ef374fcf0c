"""Rolling-window indicators: window functions only, null until the window is full.

Every function adds columns to ``df``.  ``x`` is the input column.  Windows of
one series share their partitioning and order, so Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import div_by_zero, divide
from ..functions.windows import BY, ORDER, position, series, trailing, warm


def rolling(df: DataFrame, f: Callable[[Column], Column], n: int, name: str, x: str = "close", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Any aggregate ``f`` of the last ``n`` values."""
    return df.withColumn(name, warm(f(F.col(x)).over(trailing(n, by, order)), n, by, order))


def apply_n(df: DataFrame, func: Callable, n: int, name: str, x: str = "close", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """A Python function of the last ``n`` values (a numpy array), run in Arrow batches."""
    import pandas as pd

    def run(windows: pd.Series) -> pd.Series:
        return windows.map(lambda v: None if v is None or len(v) < n else float(func(v)))

    run.__annotations__ = {"windows": pd.Series, "return": pd.Series}
    return df.withColumn(name, F.pandas_udf(run, "double")(F.collect_list(x).over(trailing(n, by, order))))


def highest(df: DataFrame, n: int = 14, x: str = "close", name: str = "highest", **key: Sequence[str]) -> DataFrame:
    return rolling(df, F.max, n, name, x, **key)


def lowest(df: DataFrame, n: int = 14, x: str = "close", name: str = "lowest", **key: Sequence[str]) -> DataFrame:
    return rolling(df, F.min, n, name, x, **key)


def _bars_back(x: Column, n: int, by: Sequence[str], order: Sequence[str], sign: int) -> Column:
    """Bars since the latest extreme of the last ``n`` rows."""
    return position(by, order) - F.max_by(F.col("_rn"), F.struct(x * sign, F.col("_rn"))).over(trailing(n, by, order))


def index_highest(df: DataFrame, n: int = 14, x: str = "close", name: str = "index_highest", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Bars back to the latest maximum (0: the current bar)."""
    return df.withColumn("_rn", position(by, order)).withColumn(name, warm(_bars_back(F.col(x), n, by, order, 1), n, by, order)).drop("_rn")


def index_lowest(df: DataFrame, n: int = 14, x: str = "close", name: str = "index_lowest", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Bars back to the latest minimum."""
    return df.withColumn("_rn", position(by, order)).withColumn(name, warm(_bars_back(F.col(x), n, by, order, -1), n, by, order)).drop("_rn")


def sma(df: DataFrame, n: int = 9, x: str = "close", name: str = "sma", **key: Sequence[str]) -> DataFrame:
    return rolling(df, F.avg, n, name, x, **key)


def wma(df: DataFrame, n: int = 30, x: str = "close", name: str = "wma", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Weights 1 .. n: the sum of row number times value less (row number - n) times the sum."""
    w = trailing(n, by, order)
    rows = df.withColumn("_rn", position(by, order).cast("double"))
    value = (F.sum(F.col("_rn") * F.col(x)).over(w) - (F.col("_rn") - n) * F.sum(x).over(w)) * (2.0 / (n * (n + 1)))
    return rows.withColumn(name, warm(value, n, by, order)).drop("_rn")


def stddev(df: DataFrame, n: int = 20, x: str = "close", deviations: float = 1.0, name: str = "stddev", **key: Sequence[str]) -> DataFrame:
    """Population standard deviation times ``deviations``."""
    return rolling(df, lambda c: F.stddev_pop(c), n, name, x, **key) if deviations == 1.0 else _scaled(df, n, x, deviations, name, **key)


def _scaled(df: DataFrame, n: int, x: str, k: float, name: str, **key: Sequence[str]) -> DataFrame:
    return rolling(df, F.stddev_pop, n, name, x, **key).withColumn(name, F.col(name) * k)


def bollinger(df: DataFrame, n: int = 20, deviations: float = 2.0, x: str = "close", **key: Sequence[str]) -> DataFrame:
    """Adds bb_mid, bb_top and bb_bot."""
    out = rolling(rolling(df, F.avg, n, "bb_mid", x, **key), F.stddev_pop, n, "_sd", x, **key)
    return out.withColumns({"bb_top": F.col("bb_mid") + deviations * F.col("_sd"), "bb_bot": F.col("bb_mid") - deviations * F.col("_sd")}).drop("_sd")


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def cci(df: DataFrame, n: int = 14, factor: float = 0.015, name: str = "cci", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Distance of the typical price from its mean in mean deviations; 0 for a flat window."""
    w = trailing(n, by, order)
    rows = df.withColumn("_tp", typical()).withColumns({"_m": F.avg("_tp").over(w), "_v": F.collect_list("_tp").over(w)})
    deviation = F.aggregate("_v", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("_m"))) / n
    return rows.withColumn("_d", deviation).withColumn(name, warm(divide(F.col("_tp") - F.col("_m"), factor * F.col("_d")), n, by, order)).drop("_tp", "_m", "_v", "_d")


def momentum(df: DataFrame, n: int = 12, x: str = "close", name: str = "momentum", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    return df.withColumn(name, F.col(x) - F.lag(x, n).over(series(by, order)))


def percent_change(df: DataFrame, n: int = 30, x: str = "close", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds roc ((x/p - 1) 100), rocp ((x - p)/p) and rocr (x/p)."""
    p = F.lag(x, n).over(series(by, order))
    return df.withColumn("_p", p).withColumns({"roc": (F.try_divide(F.col(x), F.col("_p")) - 1) * 100, "rocp": F.try_divide(F.col(x) - F.col("_p"), F.col("_p")), "rocr": F.try_divide(F.col(x), F.col("_p"))}).drop("_p")


def aroon(df: DataFrame, n: int = 14, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds aroon_up, aroon_down and aroon_osc from the bars since the extremes of n + 1 rows."""
    rows = df.withColumn("_rn", position(by, order))
    up = 100.0 * (n - _bars_back(F.col("high"), n + 1, by, order, 1)) / n
    down = 100.0 * (n - _bars_back(F.col("low"), n + 1, by, order, -1)) / n
    out = rows.withColumns({"aroon_up": warm(up, n + 1, by, order), "aroon_down": warm(down, n + 1, by, order)}).drop("_rn")
    return out.withColumn("aroon_osc", F.col("aroon_up") - F.col("aroon_down"))


def awesome(df: DataFrame, fast: int = 5, slow: int = 34, name: str = "ao", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Difference of two means of the bars' middles."""
    middle = (F.col("high") + F.col("low")) / 2
    value = F.avg(middle).over(trailing(fast, by, order)) - F.avg(middle).over(trailing(slow, by, order))
    return df.withColumn(name, warm(value, max(fast, slow), by, order))


def acceleration(df: DataFrame, fast: int = 5, slow: int = 34, n: int = 5, name: str = "ac", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """The awesome oscillator less its own mean."""
    rows = awesome(df, fast, slow, "_ao", by=by, order=order)
    mean = F.avg("_ao").over(trailing(n, by, order))
    return rows.withColumn(name, warm(F.col("_ao") - mean, max(fast, slow) + n - 1, by, order)).drop("_ao")


def price_oscillator(df: DataFrame, fast: int = 12, slow: int = 26, x: str = "close", ma: str = "sma", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds apo (fast less slow average) and ppo (in percent of the slow one); ``ma`` is sma or ema."""
    if ma == "ema":
        from .recursive import emas

        rows = emas(df, {"_f": (fast, x), "_s": (slow, x)}, by=by, order=order)
    else:
        rows = sma(sma(df, fast, x, "_f", by=by, order=order), slow, x, "_s", by=by, order=order)
    return rows.withColumns({"apo": F.col("_f") - F.col("_s"), "ppo": 100 * F.try_divide(F.col("_f") - F.col("_s"), F.col("_s"))}).drop("_f", "_s")


def true_range(*, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """max(h - l, |h - last close|, |l - last close|), null on a series' first bar."""
    c = F.lag("close").over(series(by, order))
    return F.when(c.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c)))


def pivot_point(df: DataFrame, previous: bool = False, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds p, s1, s2, r1 and r2 of this bar or the one before."""
    w = series(by, order)
    h, l_, c = (F.lag(x).over(w) if previous else F.col(x) for x in ("high", "low", "close"))
    p = (h + l_ + c) / 3
    return df.withColumns({"p": p, "s1": 2 * p - h, "r1": 2 * p - l_, "s2": p - (h - l_), "r2": p + (h - l_)})


def relative_volume(df: DataFrame, n: int = 20, name: str = "relative_volume", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """The volume n bars ago over this one's; 0 for no volume."""
    return df.withColumn(name, div_by_zero(F.lag("volume", n).over(series(by, order)), F.col("volume")))


def relative_volume_by_slot(df: DataFrame, name: str = "relative_volume", *, by: Sequence[str] = BY, ts: str = "ts") -> DataFrame:
    """Volume over that of the same time of day on the day before, while the slot has missed no day of its series."""
    from pyspark.sql import Window as W

    slot, day = F.date_format(ts, "HH:mm:ss"), F.to_date(ts)
    rows = df.withColumns({"_slot": slot, "_day": day})
    rank = F.dense_rank().over(W.partitionBy(*by).orderBy("_day"))
    w = W.partitionBy(*by, "_slot").orderBy("_day", ts)
    seen = F.row_number().over(w)
    rows = rows.withColumn("_rank", rank)
    return rows.withColumn(name, F.when(seen == F.col("_rank"), F.try_divide(F.col("volume"), F.lag("volume").over(w)))).drop("_slot", "_day", "_rank")


def pearson_r(df: DataFrame, n: int = 20, a: str = "close", b: str = "volume", name: str = "pearson_r", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Correlation of two columns over the last n rows; NaN where either stands still."""
    w, both = trailing(n, by, order), F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, F.col(a))).over(w)) * F.sqrt(F.var_pop(F.when(both, F.col(b))).over(w))
    rows = df.withColumns({"_cov": F.covar_pop(a, b).over(w), "_spread": spread})  # corr itself fails where the spread is 0
    value = F.when(F.col("_spread") == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("_cov"), F.col("_spread")))
    return rows.withColumn(name, warm(value, n, by, order)).drop("_cov", "_spread")


def drop_size(df: DataFrame, approach: str = "closeclose", name: str = "drop_size", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """A bar's fall: closeclose, openclose, highclose or highlow."""
    last = F.lag("close").over(series(by, order))
    ways = {
        "closeclose": F.try_divide(F.col("close"), last), "openclose": F.try_divide(F.col("close"), F.col("open")),
        "highclose": F.try_divide(F.col("close"), F.col("high")), "highlow": F.try_divide(F.col("low"), F.col("high")),
    }
    return df.withColumn(name, ways[approach] - 1)


def sma_direction(df: DataFrame, n: int = 30, k: int = 10, x: str = "close", name: str = "sma_direction", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """The mean less the mean k bars ago."""
    rows = sma(df, n, x, "_sma", by=by, order=order)
    return rows.withColumn(name, F.col("_sma") - F.lag("_sma", k).over(series(by, order))).drop("_sma")
