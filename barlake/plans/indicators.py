"""Queries of expressions, rolling and recursive indicators and crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cross, fill, recursive, rolling
from .base import DAYS, MONTHS, UPTO, S, day_bars, last, month_bars, query, r, shown, t, warm


def _x(body: str, source: str = DAYS) -> str:
    return f"{source}SELECT sid, {t()}, {body} FROM bars {S}"


@query(_x(f"{r('close + open', 'plus')}, {r('close - open', 'minus')}, {r('close * open / 1e6', 'times')}, {r('close / open', 'over')}, {r('floor(close / open)', 'floordiv')}, {r('pow(close, 0.5e0)', 'root')}, {r('-close', 'negative')}, {r('abs(open - close)', 'distance')}"))
def ex1_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("close"), F.col("open")
    return shown(day_bars(spark, sf_dir).select(
        "sid", "ts", (c + o).alias("plus"), (c - o).alias("minus"), (c * o / 1e6).alias("times"), X.divide(c, o).alias("over"), X.floor_divide(c, o).alias("floordiv"), X.power(c, F.lit(0.5)).alias("root"),
        (-c).alias("negative"), X.absolute(o - c).alias("distance"),
    ))


@query(_x(f"{r('CASE WHEN abs(high - low) < 1e-8 THEN 0.0e0 ELSE close / (high - low) END', 'safe')}, {r('CASE WHEN high - low = 0 THEN 7.0e0 ELSE close / (high - low) END', 'zero')}, {r('CASE WHEN high - low = 0 AND close - open = 0 THEN 5.0e0 WHEN high - low = 0 THEN 9.0e0 ELSE (close - open) / (high - low) END', 'dual')}"))
def ex2_safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, span = F.col("close"), F.col("high") - F.col("low")
    return shown(day_bars(spark, sf_dir).select("sid", "ts", X.divide(c, span).alias("safe"), X.div_by_zero(c, span, 7.0).alias("zero"), X.div_zero_by_zero(c - F.col("open"), span, 9.0, 5.0).alias("dual")))


@query(_x("(close > open)::INT::DOUBLE AS gt, (close <= open)::INT::DOUBLE AS le, (close = open)::INT::DOUBLE AS eq, (close <> open)::INT::DOUBLE AS ne, (strftime(ts, '%H:%M:%S') < '12:00:00')::INT::DOUBLE AS morning"))
def ex4_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("close"), F.col("open")
    ops = {"gt": ">", "le": "<=", "eq": "==", "ne": "!="}
    return shown(day_bars(spark, sf_dir).select("sid", "ts", *[X.compare(c, op, o).alias(k) for k, op in ops.items()], X.time_compare(F.col("ts"), "<", "12:00:00").alias("morning")))


@query(_x(f"{r('lag(close, 3) OVER s', 'delayed')}, {r('lead(close, 2) OVER s', 'ahead')}, 0.0e0 AS zero, len(list(close) OVER {last(5)}) AS n_last, {r(f'list_sum(list(close) OVER {last(5)})', 'sum_last')}"))
def ex6_delay_and_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = X.last_values(F.col("close"), 5)
    rows = day_bars(spark, sf_dir).withColumns({"delayed": X.delay(F.col("close"), 3), "ahead": X.forward(F.col("close"), 2), "_v": values})
    return shown(rows.select("sid", "ts", "delayed", "ahead", F.lit(0.0).alias("zero"), F.size("_v").cast("long").alias("n_last"), F.aggregate("_v", F.lit(0.0), lambda a, v: a + v).alias("sum_last")))


@query(_x(f"{r('close - open', 'cmp')}, CASE WHEN close < open THEN 1.0e0 WHEN close = open THEN 2.0e0 ELSE 3.0e0 END AS three, {r('CASE WHEN close > open THEN high ELSE low END', 'chosen')}, (close > open AND volume > 20)::INT::DOUBLE AS both, (close > open OR volume > 20)::INT::DOUBLE AS either, {r('greatest(open, close)', 'most')}, {r('least(open, close)', 'least')}, {r('open + close + high', 'sum')}, {r('greatest(open, high, low, close)', 'folded')}"))
def ex12_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, h, l_, c = (F.col(x) for x in ("open", "high", "low", "close"))
    up, busy = X.compare(c, ">", o), X.compare(F.col("volume"), ">", F.lit(20))
    return shown(day_bars(spark, sf_dir).select(
        "sid", "ts", X.cmp(c, o).alias("cmp"), X.cmp_ex(c, o, F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("three"), X.choose(up, h, l_).alias("chosen"), X.all_of(up, busy).alias("both"), X.any_of(up, busy).alias("either"),
        X.max_of(o, c).alias("most"), X.min_of(o, c).alias("least"), X.sum_of(o, c, h).alias("sum"), X.fold(lambda a, b: F.greatest(a, b), o, h, l_, c).alias("folded"),
    ))


@query(_x(f"{r(warm(f'max(close) OVER {last(14)}', 14), 'highest')}, {r(warm(f'min(close) OVER {last(14)}', 14), 'lowest')}"))
def wn2_highest_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.lowest(rolling.highest(day_bars(spark, sf_dir))), "sid", "ts", "highest", "lowest")


_NUM = f"{DAYS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts) AS n FROM bars) "


@query(f"{_NUM}, w AS (SELECT sid, ts, n, close, max(close) OVER {last(14)} AS hi, min(close) OVER {last(14)} AS lo FROM numbered) SELECT a.sid, {t('a.ts', 'ts')}, CASE WHEN any_value(a.n) >= 14 THEN min(CASE WHEN b.close = a.hi THEN a.n - b.n END) END AS index_highest, CASE WHEN any_value(a.n) >= 14 THEN min(CASE WHEN b.close = a.lo THEN a.n - b.n END) END AS index_lowest FROM w a JOIN numbered b ON a.sid = b.sid AND b.n BETWEEN a.n - 13 AND a.n GROUP BY a.sid, a.ts")
def wn4_find_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.index_lowest(rolling.index_highest(day_bars(spark, sf_dir))), "sid", "ts", F.col("index_highest").cast("long"), F.col("index_lowest").cast("long"))


@query(_x(f"{r(warm(f'avg(close) OVER {last(9)}', 9), 'sma')}, {r(warm(f'avg(close) OVER {last(30)}', 30), 'sma_30')}, {r(warm(f'stddev_pop(close) OVER {last(20)}', 20), 'stddev')}"))
def wn6_sma_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = rolling.sma(rolling.sma(day_bars(spark, sf_dir)), 30, name="sma_30")
    return shown(rolling.stddev(bars), "sid", "ts", "sma", "sma_30", "stddev")


@query(f"{_NUM} SELECT a.sid, {t('a.ts', 'ts')}, {r('CASE WHEN any_value(a.n) >= 30 THEN sum(b.close * (b.n - a.n + 30)) * 2 / (30.0e0 * 31) END', 'wma')} FROM numbered a JOIN numbered b ON a.sid = b.sid AND b.n BETWEEN a.n - 29 AND a.n GROUP BY a.sid, a.ts")
def wn7_wma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.wma(day_bars(spark, sf_dir)), "sid", "ts", "wma")


@query(_x(f"{r(warm(f'avg(close) OVER {last(20)}', 20), 'bb_mid')}, {r(warm(f'avg(close) OVER {last(20)} + 2 * stddev_pop(close) OVER {last(20)}', 20), 'bb_top')}, {r(warm(f'avg(close) OVER {last(20)} - 2 * stddev_pop(close) OVER {last(20)}', 20), 'bb_bot')}"))
def wn9_bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.bollinger(day_bars(spark, sf_dir)), "sid", "ts", "bb_mid", "bb_top", "bb_bot")


@query(f"{_NUM}, tp AS (SELECT sid, ts, n, (high + low + close) / 3 AS v, avg((high + low + close) / 3) OVER {last(14)} AS m FROM numbered) SELECT a.sid, {t('a.ts', 'ts')}, {r('CASE WHEN any_value(a.n) >= 14 THEN CASE WHEN 0.015e0 * sum(abs(b.v - a.m)) / 14 < 1e-8 THEN 0.0e0 ELSE (any_value(a.v) - any_value(a.m)) / (0.015e0 * sum(abs(b.v - a.m)) / 14) END END', 'cci')} FROM tp a JOIN tp b ON a.sid = b.sid AND b.n BETWEEN a.n - 13 AND a.n GROUP BY a.sid, a.ts")
def wn10_cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.cci(day_bars(spark, sf_dir)), "sid", "ts", "cci")


@query(_x(f"{r('close - lag(close, 12) OVER s', 'momentum')}, {r('(close / lag(close, 30) OVER s - 1) * 100', 'roc')}, {r('(close - lag(close, 30) OVER s) / lag(close, 30) OVER s', 'rocp')}, {r('close / lag(close, 30) OVER s', 'rocr')}"))
def wn11_momentum_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.percent_change(rolling.momentum(day_bars(spark, sf_dir))), "sid", "ts", "momentum", "roc", "rocp", "rocr")


@query(f"{_NUM}, w AS (SELECT sid, ts, n, max(high) OVER {last(15)} AS hi, min(low) OVER {last(15)} AS lo FROM numbered), e AS (SELECT a.sid, a.ts, any_value(a.n) AS n, min(CASE WHEN b.high = a.hi THEN a.n - b.n END) AS u, min(CASE WHEN b.low = a.lo THEN a.n - b.n END) AS v FROM w a JOIN numbered b ON a.sid = b.sid AND b.n BETWEEN a.n - 14 AND a.n GROUP BY a.sid, a.ts) SELECT sid, {t()}, {r('CASE WHEN n >= 15 THEN 100.0e0 * (14 - u) / 14 END', 'aroon_up')}, {r('CASE WHEN n >= 15 THEN 100.0e0 * (14 - v) / 14 END', 'aroon_down')}, {r('CASE WHEN n >= 15 THEN 100.0e0 * (v - u) / 14 END', 'aroon_osc')} FROM e")
def wn13_aroon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.aroon(day_bars(spark, sf_dir)), "sid", "ts", "aroon_up", "aroon_down", "aroon_osc")


_AO = f"{DAYS}, ao AS (SELECT sid, ts, {warm(f'avg((high + low) / 2) OVER {last(5)} - avg((high + low) / 2) OVER {last(34)}', 34)} AS ao FROM bars {S}) "


@query(f"{_AO} SELECT sid, {t()}, {r('ao')}, {r(warm(f'ao - avg(ao) OVER {last(5)}', 38), 'ac')} FROM ao {S}")
def wn14_awesome_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.acceleration(rolling.awesome(day_bars(spark, sf_dir))), "sid", "ts", "ao", "ac")


@query(f"{DAYS}, m AS (SELECT sid, ts, {warm(f'avg(close) OVER {last(12)}', 12)} AS f, {warm(f'avg(close) OVER {last(26)}', 26)} AS g FROM bars {S}) SELECT sid, {t()}, {r('f - g', 'apo')}, {r('100 * (f - g) / g', 'ppo')} FROM m")
def wn16_price_oscillator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.price_oscillator(day_bars(spark, sf_dir)), "sid", "ts", "apo", "ppo")


@query(_x(f"{r('CASE WHEN lag(close) OVER s IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) END', 'true_range')}"))
def wn17_true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(day_bars(spark, sf_dir).withColumn("true_range", rolling.true_range()), "sid", "ts", "true_range")


_P = "(lag(high) OVER s + lag(low) OVER s + lag(close) OVER s) / 3"


@query(_x(f"{r(_P, 'p')}, {r(f'2 * {_P} - lag(high) OVER s', 's1')}, {r(f'2 * {_P} - lag(low) OVER s', 'r1')}, {r(f'{_P} - (lag(high) OVER s - lag(low) OVER s)', 's2')}, {r(f'{_P} + (lag(high) OVER s - lag(low) OVER s)', 'r2')}"))
def wn18_pivot_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.pivot_point(day_bars(spark, sf_dir), previous=True), "sid", "ts", "p", "s1", "r1", "s2", "r2")


@query(_x(f"{r('CASE WHEN lag(volume, 20) OVER s IS NULL THEN NULL WHEN volume = 0 THEN 0.0e0 ELSE lag(volume, 20) OVER s / volume END', 'relative_volume')}, {r(warm(f'corr(close, volume) OVER {last(20)}', 20), 'pearson_r')}"))
def wn19_relative_volume_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.pearson_r(rolling.relative_volume(day_bars(spark, sf_dir))), "sid", "ts", "relative_volume", "pearson_r")


@query(_x(f"{r('close / lag(close) OVER s - 1', 'closeclose')}, {r('close / open - 1', 'openclose')}, {r('close / high - 1', 'highclose')}, {r('low / high - 1', 'highlow')}"))
def wn22_drop_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = day_bars(spark, sf_dir)
    for way in ("closeclose", "openclose", "highclose", "highlow"):
        bars = rolling.drop_size(bars, way, way)
    return shown(bars, "sid", "ts", "closeclose", "openclose", "highclose", "highlow")


@query(f"{DAYS}, m AS (SELECT sid, ts, {warm(f'avg(close) OVER {last(30)}', 30)} AS m FROM bars {S}) SELECT sid, {t()}, {r('m - lag(m, 10) OVER s', 'sma_direction')} FROM m {S}")
def wn23_sma_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.sma_direction(day_bars(spark, sf_dir)), "sid", "ts", "sma_direction")


@query(_x(f"{r(warm(f'max(close) OVER {last(5)} - min(close) OVER {last(5)}', 5), 'spread')}"))
def wn1_apply_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.apply_n(day_bars(spark, sf_dir), lambda v: max(v) - min(v), 5, "spread"), "sid", "ts", "spread")


# --- crossings ----------------------------------------------------------------

_CX = f"{DAYS}, m AS (SELECT sid, ts, avg(close) OVER {last(5)} AS a, avg(close) OVER {last(20)} AS b FROM bars), d AS (SELECT *, coalesce(last_value(nullif(a - b, 0) IGNORE NULLS) OVER {UPTO}, 0.0e0) AS nzd FROM m), w AS (SELECT *, lag(nzd) OVER (PARTITION BY sid ORDER BY ts) AS was FROM d) "


@query(f"{_CX} SELECT sid, {t()}, {r('nzd')}, CASE WHEN was < 0 AND a > b THEN 1.0e0 ELSE 0.0e0 END AS cross_up, CASE WHEN was > 0 AND a < b THEN 1.0e0 ELSE 0.0e0 END AS cross_down, CASE WHEN was < 0 AND a > b THEN 1.0e0 WHEN was > 0 AND a < b THEN -1.0e0 ELSE 0.0e0 END AS crossover FROM w")
def cx1_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.windows import trailing

    bars = day_bars(spark, sf_dir).withColumns({"a": F.avg("close").over(trailing(5)), "b": F.avg("close").over(trailing(20))})
    bars = bars.withColumn("nzd", cross.nonzero_difference(F.col("a"), F.col("b")))
    return shown(cross.crossover(cross.cross_down(cross.cross_up(bars, "a", "b"), "a", "b"), "a", "b"), "sid", "ts", "nzd", "cross_up", "cross_down", "crossover")


# --- recursion: monthly bars, so that SQL can follow it row by row ---------------


def _smooth(source: str, x: str, k: str, n: int, out: str, given: str) -> str:
    """CTEs: ``out`` holds y by (sid, rn) from relation ``source`` with column x and row number rn from its first known value."""
    return (
        f", {out}_in AS (SELECT sid, rn, {x} AS x, row_number() OVER (PARTITION BY sid ORDER BY rn) AS i FROM {source} WHERE {x} IS NOT NULL)"
        f", {out}_seed AS (SELECT sid, max(rn) AS rn, {n} AS i, avg(x) AS y FROM {out}_in WHERE i <= {n} GROUP BY sid HAVING count(*) = {n})"
        f", {out} AS (SELECT sid, rn, i, y FROM {out}_seed UNION ALL SELECT b.sid, b.rn, b.i, (1 - {k}) * r.y + {k} * b.x FROM {out} r JOIN {out}_in b ON b.sid = r.sid AND b.i = r.i + 1){given}"
    )


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day bars without the columns that a scan would carry along for nothing, by series in more and smaller tasks.

    The windows by series need this shuffle anyway; a scan's task holds several sorts of its rows at once.
    """
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return day_bars(spark, sf_dir).select("sid", "ts", "close").repartition(parts, "sid")


_M = f"{MONTHS}, nb AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts) AS rn FROM bars)"
_EMA = _M + _smooth("nb", "close", "(2.0e0 / 11)", 10, "e1", "")


@query(f"{_EMA.replace(MONTHS, DAYS)} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('e1.y', 'ema')} FROM nb LEFT JOIN e1 ON nb.sid = e1.sid AND nb.rn = e1.rn")
def rc1_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recursive.ema(_closes(spark, sf_dir), 10), "sid", "ts", "ema")


_OSC = _M.replace(MONTHS, DAYS) + _smooth("nb", "close", "(2.0e0 / 13)", 12, "f", "") + _smooth("nb", "close", "(2.0e0 / 27)", 26, "g", "")


@query(f"{_OSC} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('f.y - g.y', 'apo')}, {r('100 * (f.y - g.y) / g.y', 'ppo')} FROM nb LEFT JOIN f ON nb.sid = f.sid AND nb.rn = f.rn LEFT JOIN g ON nb.sid = g.sid AND nb.rn = g.rn")
def wn16_price_oscillator_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oscillator of exponential averages."""
    return shown(rolling.price_oscillator(_closes(spark, sf_dir), ma="ema"), "sid", "ts", "apo", "ppo")


_E3 = _EMA + _smooth("e1", "y", "(2.0e0 / 11)", 10, "e2", "") + _smooth("e2", "y", "(2.0e0 / 11)", 10, "e3", "")


@query(f"{_E3} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('2 * e1.y - e2.y', 'dema')}, {r('3 * e1.y - 3 * e2.y + e3.y', 'tema')} FROM nb LEFT JOIN e1 ON nb.sid = e1.sid AND nb.rn = e1.rn LEFT JOIN e2 ON nb.sid = e2.sid AND nb.rn = e2.rn LEFT JOIN e3 ON nb.sid = e3.sid AND nb.rn = e3.rn")
def rc2_dema_tema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recursive.tema(recursive.dema(month_bars(spark, sf_dir), 10), 10), "sid", "ts", "dema", "tema")


_KAMA = f"{_M}, mv AS (SELECT *, abs(close - lag(close) OVER (PARTITION BY sid ORDER BY ts)) AS mv FROM nb), er AS (SELECT *, abs(close - lag(close, 10) OVER (PARTITION BY sid ORDER BY ts)) AS num, sum(mv) OVER {last(10)} AS den FROM mv), sc AS (SELECT *, pow(CASE WHEN abs(den) < 1e-8 THEN 0.0e0 ELSE num / den END * (2.0e0 / 3 - 2.0e0 / 31) + 2.0e0 / 31, 2) AS sc FROM er), k AS (SELECT sid, 10 AS rn, avg(close) AS y FROM nb WHERE rn <= 10 GROUP BY sid HAVING count(*) = 10 UNION ALL SELECT b.sid, b.rn, (1 - b.sc) * k.y + b.sc * b.close FROM k JOIN sc b ON b.sid = k.sid AND b.rn = k.rn + 1)"


@query(f"{_KAMA.replace(MONTHS, DAYS)} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('k.y', 'kama')} FROM nb LEFT JOIN k ON nb.sid = k.sid AND nb.rn = k.rn")
def rc4_kama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recursive.kama(_closes(spark, sf_dir), 10), "sid", "ts", "kama")


_MACD = _M + _smooth("nb", "close", "(2.0e0 / 13)", 12, "f", "") + _smooth("nb", "close", "(2.0e0 / 27)", 26, "g", "") + ", md AS (SELECT f.sid, f.rn, f.y - g.y AS m FROM f JOIN g ON f.sid = g.sid AND f.rn = g.rn)" + _smooth("md", "m", "(2.0e0 / 10)", 9, "h", "")


@query(f"{_MACD.replace(MONTHS, DAYS)} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('md.m', 'macd')}, {r('h.y', 'macd_signal')}, {r('md.m - h.y', 'macd_histo')} FROM nb LEFT JOIN md ON nb.sid = md.sid AND nb.rn = md.rn LEFT JOIN h ON nb.sid = h.sid AND nb.rn = h.rn")
def rc5_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recursive.macd(_closes(spark, sf_dir)), "sid", "ts", "macd", "macd_signal", "macd_histo")


_TR = f"{_M}, lg AS (SELECT *, lag(close) OVER (PARTITION BY sid ORDER BY ts) AS pc, lag(high) OVER (PARTITION BY sid ORDER BY ts) AS ph, lag(low) OVER (PARTITION BY sid ORDER BY ts) AS pl FROM nb), tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS dn, CASE WHEN ph IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0e0 END END AS pm, CASE WHEN ph IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0e0 END END AS mm FROM lg)"
_W14 = "(1.0e0 / 14)"
ATR = _TR + _smooth("tr", "tr", _W14, 14, "atr", "")


@query(f"{ATR} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('atr.y', 'atr')}, {r('100 * atr.y / nb.close', 'natr')} FROM nb LEFT JOIN atr ON nb.sid = atr.sid AND nb.rn = atr.rn")
def rc6_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recursive.atr(month_bars(spark, sf_dir)), "sid", "ts", "atr", "natr")


RSI = _TR + _smooth("tr", "up", _W14, 14, "u", "") + _smooth("tr", "dn", _W14, 14, "v", "")


@query(f"{RSI.replace(MONTHS, DAYS)} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('CASE WHEN v.y = 0 AND u.y = 0 THEN 50.0e0 WHEN v.y = 0 THEN 100.0e0 ELSE 100 - 100 / (1 + u.y / v.y) END', 'rsi')} FROM nb LEFT JOIN u ON nb.sid = u.sid AND nb.rn = u.rn LEFT JOIN v ON nb.sid = v.sid AND nb.rn = v.rn")
def rc7_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recursive.rsi(_closes(spark, sf_dir)), "sid", "ts", "rsi")


_DI = ATR + _smooth("tr", "pm", _W14, 14, "p", "") + _smooth("tr", "mm", _W14, 14, "m", "") + ", di AS (SELECT atr.sid, atr.rn, 100 * p.y / atr.y AS pdi, 100 * m.y / atr.y AS mdi FROM atr JOIN p ON p.sid = atr.sid AND p.rn = atr.rn JOIN m ON m.sid = atr.sid AND m.rn = atr.rn), dx AS (SELECT *, CASE WHEN abs(pdi + mdi) < 1e-8 THEN 0.0e0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM di)" + _smooth("dx", "dx", _W14, 14, "ax", "")


@query(f"{_DI} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('di.pdi', 'plus_di')}, {r('di.mdi', 'minus_di')}, {r('ax.y', 'adx')}, {r('(ax.y + old.y) / 2', 'adxr')} FROM nb LEFT JOIN di ON nb.sid = di.sid AND nb.rn = di.rn LEFT JOIN ax ON nb.sid = ax.sid AND nb.rn = ax.rn LEFT JOIN ax old ON nb.sid = old.sid AND nb.rn = old.rn + 14")
def rc8_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recursive.directional(month_bars(spark, sf_dir)), "sid", "ts", "plus_di", "minus_di", "adx", "adxr")


_HA = f"{_M}, hc AS (SELECT *, (open + high + low + close) / 4 AS hc FROM nb), ho AS (SELECT sid, rn, (open + close) / 2 AS y, hc FROM hc WHERE rn = 1 UNION ALL SELECT b.sid, b.rn, (ho.y + ho.hc) / 2, b.hc FROM ho JOIN hc b ON b.sid = ho.sid AND b.rn = ho.rn + 1), ha AS (SELECT nb.sid, nb.ts, ho.y AS ha_open, ho.hc AS ha_close, greatest(nb.high, ho.y, ho.hc) AS ha_high, least(nb.low, ho.y, ho.hc) AS ha_low FROM nb JOIN ho ON nb.sid = ho.sid AND nb.rn = ho.rn)"


@query(f"{_HA} SELECT sid, {t()}, {r('ha_open')}, {r('ha_high')}, {r('ha_low')}, {r('ha_close')} FROM ha")
def fl10_heikin_ashi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fill.heikin_ashi(month_bars(spark, sf_dir)), "sid", "ts", "ha_open", "ha_high", "ha_low", "ha_close")


@query(f"{_HA} SELECT sid, {t()}, {r('ha_close - ha_open', 'ha_delta')}, {r(warm(f'avg(ha_close - ha_open) OVER {last(3)}', 3), 'ha_delta_smooth')} FROM ha {S}")
def rc13_ha_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recursive.ha_delta(month_bars(spark, sf_dir)), "sid", "ts", "ha_delta", "ha_delta_smooth")
