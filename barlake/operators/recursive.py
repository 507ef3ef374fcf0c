"""Recursive indicators as affine scans.

The first value of an average stands at the n-th known input and is the mean of
the first n; then it recurs.  Inputs may begin late (an average of an average):
rows are counted from the first known value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import divide
from ..functions.windows import BY, ORDER, expanding, series, trailing
from .fill import heikin_ashi
from .rolling import true_range
from .scan import affine_scans
from .stretches import running


def _averages(df: DataFrame, wanted: Mapping[str, tuple[float, int, str]], by: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """For each name (k, n, x): y = (1 - k) y + k x, begun with the mean of the first n known values; ``width`` as in ``affine_scan``."""
    xs = list(dict.fromkeys(x for _, _, x in wanted.values()))
    known, seed = ({x: f"_{part}{i}" for i, x in enumerate(xs)} for part in ("known", "seed"))
    if width is None:
        rows = df.withColumns({known[x]: F.count(x).over(expanding(by, order)) for x in xs} | {seed[x]: F.avg(x).over(expanding(by, order)) for x in xs})
    else:
        rows = running(df, {known[x]: ("count", F.col(x)) for x in xs} | {seed[x]: ("sum", F.col(x)) for x in xs}, by=by, order=order, width=width)
        rows = rows.withColumns({seed[x]: F.try_divide(seed[x], known[x]) for x in xs})
    maps = {}
    for name, (k, n, x) in wanted.items():
        v, count = F.col(x), F.col(known[x])
        a = F.when(v.isNull() | (count < n), F.lit(None).cast("double")).when(count == n, 0.0).otherwise(1 - k)
        maps[name] = (a, F.when(count == n, F.col(seed[x])).otherwise(k * v))
    return affine_scans(rows, maps, by=by, order=order, width=width, drop=[*known.values(), *seed.values()])


def emas(df: DataFrame, wanted: Mapping[str, tuple[int, str]], *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: int | None = None) -> DataFrame:
    """Several exponential averages, name: (n, x), in one pass."""
    return _averages(df, {name: (2.0 / (n + 1), n, x) for name, (n, x) in wanted.items()}, by, order, width)


def ema(df: DataFrame, n: int = 14, x: str = "close", name: str = "ema", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: int | None = None) -> DataFrame:
    """Exponential average with k = 2 / (n + 1)."""
    return _averages(df, {name: (2.0 / (n + 1), n, x)}, by, order, width)


def wilder(df: DataFrame, n: int = 14, x: str = "close", name: str = "wilder", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: int | None = None) -> DataFrame:
    """Exponential average with k = 1 / n."""
    return _averages(df, {name: (1.0 / n, n, x)}, by, order, width)


def dema(df: DataFrame, n: int = 14, x: str = "close", name: str = "dema", **key: Sequence[str]) -> DataFrame:
    rows = ema(ema(df, n, x, "_e1", **key), n, "_e1", "_e2", **key)
    return rows.withColumn(name, 2 * F.col("_e1") - F.col("_e2")).drop("_e1", "_e2")


def tema(df: DataFrame, n: int = 14, x: str = "close", name: str = "tema", **key: Sequence[str]) -> DataFrame:
    rows = ema(ema(ema(df, n, x, "_e1", **key), n, "_e1", "_e2", **key), n, "_e2", "_e3", **key)
    return rows.withColumn(name, 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")).drop("_e1", "_e2", "_e3")


def kama(df: DataFrame, n: int = 30, x: str = "close", fast: int = 2, slow: int = 30, name: str = "kama", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Average whose step follows the efficiency ratio of the last n moves; begun with the mean of n values."""
    w, f, s = series(by, order), 2.0 / (fast + 1), 2.0 / (slow + 1)
    v = F.col(x)
    rows = df.withColumn("_move", F.abs(v - F.lag(x).over(w)))
    ratio = divide(F.abs(v - F.lag(x, n).over(w)), F.sum("_move").over(trailing(n, by, order)))
    rows = rows.withColumns({"_sc": F.pow(ratio * (f - s) + s, F.lit(2)), "_n": F.row_number().over(w), "_seed": F.avg(x).over(trailing(n, by, order))})
    a = F.when(F.col("_n") < n, F.lit(None).cast("double")).when(F.col("_n") == n, 0.0).otherwise(1 - F.col("_sc"))
    rows = rows.withColumns({"_a": a, "_b": F.when(F.col("_n") == n, F.col("_seed")).otherwise(F.col("_sc") * v)}).drop("_move", "_sc", "_n", "_seed")
    return affine_scans(rows, {name: (F.col("_a"), F.col("_b"))}, by=by, order=order, drop=("_a", "_b"))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close", **key: Sequence[str]) -> DataFrame:
    """Adds macd, macd_signal and macd_histo."""
    rows = emas(df, {"_f": (fast, x), "_s": (slow, x)}, **key).withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    return ema(rows, signal, "macd", "macd_signal", **key).withColumn("macd_histo", F.col("macd") - F.col("macd_signal"))


def atr(df: DataFrame, n: int = 14, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds atr and natr (in percent of the close)."""
    rows = wilder(df.withColumn("_tr", true_range(by=by, order=order)), n, "_tr", "atr", by=by, order=order).drop("_tr")
    return rows.withColumn("natr", 100 * F.try_divide(F.col("atr"), F.col("close")))


def rsi(df: DataFrame, n: int = 14, x: str = "close", name: str = "rsi", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """100 - 100 / (1 + up / down); 100 without down moves, 50 without any."""
    move = F.col(x) - F.lag(x).over(series(by, order))
    rows = df.withColumns({"_up": F.greatest(move, F.lit(0.0)), "_dn": F.greatest(-move, F.lit(0.0))})
    rows = rows.withColumns({c: F.when(move.isNotNull(), F.col(c)) for c in ("_up", "_dn")})
    rows = _averages(rows, {"_u": (1.0 / n, n, "_up"), "_d": (1.0 / n, n, "_dn")}, by, order)
    value = F.when((F.col("_d") == 0) & (F.col("_u") == 0), 50.0).when(F.col("_d") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_u") / F.col("_d")))
    return rows.withColumn(name, value).drop("_up", "_dn", "_u", "_d")


def directional(df: DataFrame, n: int = 14, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds plus_di, minus_di, adx and adxr."""
    w = series(by, order)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    rows = df.withColumns({"_um": up, "_dm": down, "_tr": true_range(by=by, order=order)})

    def movement(a: str, b: str) -> Column:
        return F.when(F.col(a).isNotNull(), F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)).otherwise(0.0))

    rows = rows.withColumns({"_pm": movement("_um", "_dm"), "_mm": movement("_dm", "_um")}).drop("_um", "_dm")
    rows = _averages(rows, {"_atr": (1.0 / n, n, "_tr"), "_p": (1.0 / n, n, "_pm"), "_m": (1.0 / n, n, "_mm")}, by, order)
    rows = rows.withColumns({"plus_di": 100 * divide(F.col("_p"), F.col("_atr")), "minus_di": 100 * divide(F.col("_m"), F.col("_atr"))})
    rows = rows.withColumn("_dx", 100 * divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    rows = wilder(rows, n, "_dx", "adx", by=by, order=order).drop("_tr", "_pm", "_mm", "_atr", "_p", "_m", "_dx")
    return rows.withColumn("adxr", (F.col("adx") + F.lag("adx", n).over(w)) / 2)


def ha_delta(df: DataFrame, n: int = 3, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds the averaged bars' close less open (ha_delta) and its mean (ha_delta_smooth)."""
    from .rolling import sma

    rows = heikin_ashi(df, by=by, order=order).withColumn("ha_delta", F.col("ha_close") - F.col("ha_open"))
    return sma(rows, n, "ha_delta", "ha_delta_smooth", by=by, order=order)
