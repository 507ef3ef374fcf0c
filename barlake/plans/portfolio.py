"""Queries of signals, selection, execution analytics, ledgers and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import allocate, execution, ledger, performance, signals
from ..operators.cross import crossover
from ..operators.rolling import sma
from .base import DAYS, EVENTS, HOURS, MONTHS, UPTO, S, d, day_bars, event_ticks, hour_bars, last, month_bars, query, r, shown, t, table, warm
from .indicators import RSI

# --- flagship: ticks to day bars, two averages, their crossing, the position and its return ---

_CROSS = f"WITH RECURSIVE ticks AS ({EVENTS}), keyed AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, tb) AS k FROM ticks), bars AS (SELECT sid, max(ts) AS ts, arg_max(price, k) AS close FROM keyed GROUP BY sid, ts::DATE), m AS (SELECT sid, ts, close, {warm(f'avg(close) OVER {last(3)}', 3)} AS a, {warm(f'avg(close) OVER {last(5)}', 5)} AS b FROM bars {S}), nz AS (SELECT *, CASE WHEN a - b IS NOT NULL THEN coalesce(last_value(nullif(a - b, 0) IGNORE NULLS) OVER {UPTO}, 0) END AS nzd FROM m), cx AS (SELECT *, CASE WHEN lag(nzd) OVER s < 0 AND a > b THEN 1 WHEN lag(nzd) OVER s > 0 AND a < b THEN -1 ELSE 0 END AS x FROM nz {S}), ps AS (SELECT *, coalesce(last_value(CASE WHEN x = 1 THEN 1 WHEN x = -1 THEN 0 END IGNORE NULLS) OVER {UPTO}, 0) AS position FROM cx)"


@query(f"{_CROSS} SELECT sid, {t()}, {r('close')}, x::DOUBLE AS crossover, position::BIGINT AS position, {r('coalesce(lag(position) OVER s, 0) * (close / lag(close) OVER s - 1)', 'ret')} FROM ps {S}")
def flagship_cross_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event bars, SMA(3) over SMA(5), position and the return of the held position."""
    from ..operators.resample import resample
    from ..sources.bars import ticks_as_bars

    bars = resample(ticks_as_bars(event_ticks(spark, sf_dir)), "days", tie=("tb",))
    rows = crossover(sma(sma(bars, 3, name="fast"), 5, name="slow"), "fast", "slow")
    rows = signals.position_state(rows, F.col("crossover") == 1, F.col("crossover") == -1)
    w = W.partitionBy("sid").orderBy("ts")
    ret = F.coalesce(F.lag("position").over(w), F.lit(0)) * (F.col("close") / F.lag("close").over(w) - 1)
    return shown(rows.withColumn("ret", ret), "sid", "ts", "close", "crossover", "position", "ret")


# --- signals -----------------------------------------------------------------------

_SIG = f"{DAYS}, z AS (SELECT sid, ts, close - open AS a, volume - 25 AS b, high - low AS c FROM bars)"


@query(f"{_SIG} SELECT sid, {t()}, (a > 0 AND b > 0) AS enter_long, (a < 0) OR (c <> 0) AS enter_short, (a < 0) OR (c <> 0) AS exit_long, (a > 0 AND b > 0) AS exit_short, (a < 0 AND b < 0) AS leave_long, (a > 0) AS leave_short FROM z")
def sg1_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_bars(spark, sf_dir).withColumns({"a": F.col("close") - F.col("open"), "b": F.col("volume") - 25, "c": F.col("high") - F.col("low")})
    out = signals.combine(rows, {"LONG": ["a", "b"], "SHORT": ["a"], "SHORT_ANY": ["c"]})
    return shown(out, "sid", "ts", "enter_long", "enter_short", "exit_long", "exit_short", "leave_long", "leave_short")


_STATE = f"{DAYS}, e AS (SELECT *, CASE WHEN volume > 40 THEN 1 WHEN volume < 10 THEN 0 END AS e FROM bars)"


@query(f"{_STATE} SELECT sid, {t()}, coalesce(last_value(e IGNORE NULLS) OVER {UPTO}, 0)::BIGINT AS position, coalesce(e = 1, FALSE) AND coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY sid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS entry FROM e")
def sg4_position_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    enter, leave = F.col("volume") > 40, F.col("volume") < 10
    rows = signals.entries(signals.position_state(day_bars(spark, sf_dir), enter, leave), enter, leave)
    return shown(rows, "sid", "ts", "position", "entry")


@query(f"{DAYS}, w AS (SELECT *, {warm(f'min(close) OVER {last(20)}', 20)} AS lo, {warm(f'max(close) OVER {last(20)}', 20)} AS hi, {warm(f'avg(volume) OVER {last(5)}', 5)} AS v, {warm(f'avg(close) OVER {last(10)}', 10)} AS f, {warm(f'avg(close) OVER {last(30)}', 30)} AS g, {warm(f'max(high) OVER {last(20)}', 20)} AS hh, 1 - close / max(close) OVER {UPTO} AS dd FROM bars {S}) SELECT sid, {t()}, {r('close / lo - 2', 'low_band')}, {r('close / (hi * 0.8e0) - 1', 'high_band')}, {r('v / (volume * 2) - 1', 'volume_ratio')}, {r('close / f - 1', 'sma_ratio')}, {r('close - g', 'price_less_sma')}, {r('f - g', 'sma_spread')}, CASE WHEN high = hh THEN 1.0e0 ELSE 0.0e0 END AS new_high, {r(f'0.2e0 - max(dd) OVER {UPTO}', 'drawdown_budget')} FROM w")
def sg5_signal_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = signals.high_band_ratio(signals.low_band_ratio(day_bars(spark, sf_dir), 20), 20)
    x = signals.sma_ratio(signals.volume_ratio(x), 10)
    x = signals.sma_spread(signals.price_less_sma(x), 10, 30)
    return shown(signals.drawdown_budget(signals.new_high(x)), "sid", "ts", "low_band", "high_band", "volume_ratio", "sma_ratio", "price_less_sma", "sma_spread", "new_high", "drawdown_budget")


@query(f"{DAYS}, g AS (SELECT *, sum(CASE WHEN volume > 45 THEN 1 ELSE 0 END) OVER {UPTO} AS g FROM bars), l AS (SELECT *, CASE WHEN g > 0 THEN max(close - 800) OVER (PARTITION BY sid, g ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS lv FROM g), h AS (SELECT *, coalesce((close < lag(lv) OVER (PARTITION BY sid, g ORDER BY ts))::INT, 0) AS hit FROM l), k AS (SELECT *, sum(hit) OVER (PARTITION BY sid, g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM h), z AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY sid, g ORDER BY ts), 0) > 0 AS gone FROM k) SELECT sid, {t()}, {r('CASE WHEN NOT gone THEN lv END', 'stop')}, hit = 1 AND NOT gone AS stopped FROM z")
def sg8_trailing_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_bars(spark, sf_dir).withColumns({"go": F.col("volume") > 45, "gap": F.lit(800.0)})
    return shown(signals.trailing_stop(rows, "go", "gap"), "sid", "ts", "stop", "stopped")


_STOP = f"{DAYS}, n AS (SELECT sid, ts, close, volume > 45 AS go, row_number() OVER (PARTITION BY sid ORDER BY ts) AS i FROM bars), st AS (SELECT sid, ts, i, CASE WHEN go THEN close - 800 END AS stop FROM n WHERE i = 1 UNION ALL SELECT n.sid, n.ts, n.i, CASE WHEN st.stop IS NULL THEN CASE WHEN n.go THEN n.close - 800 END WHEN n.close >= st.stop THEN greatest(st.stop, n.close - 800) END FROM st JOIN n ON n.sid = st.sid AND n.i = st.i + 1)"


@query(f"{_STOP} SELECT sid, {t()}, (stop IS NOT NULL)::BIGINT AS position, {r('stop')} FROM st")
def sg8_trailing_stop_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_bars(spark, sf_dir).withColumns({"go": F.col("volume") > 45, "gap": F.lit(800.0)})
    return shown(signals.trailing_stop_positions(rows, "go", "gap", tie=()))


_BAND = f"{RSI}, q AS (SELECT nb.sid, nb.ts, CASE WHEN v.y = 0 AND u.y = 0 THEN 50.0e0 WHEN v.y = 0 THEN 100.0e0 ELSE 100 - 100 / (1 + u.y / v.y) END AS x FROM nb LEFT JOIN u ON nb.sid = u.sid AND nb.rn = u.rn LEFT JOIN v ON nb.sid = v.sid AND nb.rn = v.rn), z AS (SELECT *, CASE WHEN x IS NOT NULL THEN coalesce(last_value(nullif(x - 30, 0) IGNORE NULLS) OVER {UPTO}, 0.0e0) END AS lo, CASE WHEN x IS NOT NULL THEN coalesce(last_value(nullif(x - 70, 0) IGNORE NULLS) OVER {UPTO}, 0.0e0) END AS hi FROM q)"


@query(f"{_BAND} SELECT sid, {t()}, {r('x', 'rsi')}, CASE WHEN lag(lo) OVER s < 0 AND x > 30 THEN 1.0e0 ELSE 0.0e0 END AS long, CASE WHEN x > 50 THEN 1.0e0 ELSE 0.0e0 END AS long_exit, CASE WHEN lag(hi) OVER s > 0 AND x < 70 THEN 1.0e0 ELSE 0.0e0 END AS short, CASE WHEN x < 50 THEN 1.0e0 ELSE 0.0e0 END AS short_exit FROM z {S}")
def sg7_rsi_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(signals.rsi_band(month_bars(spark, sf_dir)), "sid", "ts", "rsi", "long", "long_exit", "short", "short_exit")


@query(f"{MONTHS}, g AS (SELECT sid, param_id, n, ts, close, row_number() OVER (PARTITION BY sid, param_id ORDER BY ts) AS k, CASE WHEN n = 3 THEN avg(close) OVER (PARTITION BY sid, param_id ORDER BY ts ROWS 2 PRECEDING) ELSE avg(close) OVER (PARTITION BY sid, param_id ORDER BY ts ROWS 5 PRECEDING) END AS m FROM bars, (VALUES (0, 3), (1, 6)) p(param_id, n)) SELECT sid, param_id::BIGINT AS param_id, n::BIGINT AS n, {t()}, {r('CASE WHEN k >= n THEN m END', 'sma')} FROM g")
def sg10_parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.windows import position, trailing

    key = ("sid", "param_id")
    rows = signals.parameter_grid(month_bars(spark, sf_dir), {"n": [3, 6]})
    mean = F.when(F.col("n") == 3, F.avg("close").over(trailing(3, key))).otherwise(F.avg("close").over(trailing(6, key)))
    return shown(rows.withColumn("sma", F.when(position(key) >= F.col("n"), mean)), "sid", "param_id", "n", "ts", "sma")


# --- selection -----------------------------------------------------------------------------

_SCORES = "SELECT o_orderdate::DATE AS day, o_orderkey AS sid, o_totalprice AS score FROM orders"
_TOP = f"top AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, sid) AS rank FROM s WHERE score > 50000 QUALIFY rank <= 6)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("sid"), F.col("o_totalprice").alias("score"))


@query(f"WITH s AS ({_SCORES}), {_TOP} SELECT {d('day')}, sid, {r('score')}, rank, {r('1.0e0 / count(*) OVER (PARTITION BY day)', 'equal')}, {r('score / sum(score) OVER (PARTITION BY day)', 'weight')} FROM top")
def al1_top_k_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = allocate.daily_top_k(_scores(spark, sf_dir), 6, 50000.0)
    return shown(allocate.score_weight(allocate.equal_weight(picks).withColumnRenamed("weight", "equal")), "day", "sid", "score", "rank", "equal", "weight")


@query(f"WITH s AS ({_SCORES}), {_TOP} SELECT {d('day')}, string_agg(sid::VARCHAR, ',' ORDER BY rank) AS picks FROM top GROUP BY day")
def al1_top_k_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = allocate.top_k_lists(allocate.daily_top_k(_scores(spark, sf_dir), 6, 50000.0))
    return shown(lists.select("day", F.array_join(F.transform("picks", lambda p: p["sid"].cast("string")), ",").alias("picks")))


@query("SELECT o_orderkey, floor(o_totalprice * 0.2e0 / (1 + o_custkey % 97))::BIGINT AS size FROM orders")
def al5_percent_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", allocate.percent_size(F.col("o_totalprice"), 1 + F.col("o_custkey") % 97).alias("size"))


# --- fills and execution ---------------------------------------------------------------------

_FILLS = "fills AS (SELECT o.o_custkey % 50 AS experiment_id, l.l_suppkey AS sid, l.l_orderkey * 10000000000 + l.l_linenumber::BIGINT * 1000000000 + l.l_partkey AS order_id, l.l_shipdate AS executed_dt, l.l_quantity::BIGINT AS q, l.l_extendedprice / l.l_quantity AS p, l.l_tax * l.l_extendedprice / 100 AS comm, l.l_returnflag <> 'R' AS is_buy FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)"


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("experiment_id"))
    tb = F.col("l_orderkey") * 10_000_000_000 + F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")
    return li.join(o, "l_orderkey").select(
        "experiment_id", F.col("l_suppkey").alias("sid"), tb.alias("order_id"), F.col("l_shipdate").alias("executed_dt"), F.col("l_quantity").cast("long").alias("executed_size"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("executed_price"), (F.col("l_tax") * F.col("l_extendedprice") / 100).alias("comm"), (F.col("l_returnflag") != "R").alias("is_buy"),
    )


@query("WITH s AS (SELECT p_partkey, (ARRAY['688', '300', '430', '831', '600'])[(p_partkey % 5)::INT + 1] || p_partkey AS sid, DATE '2020-01-01' + (p_partkey % 900)::INT AS day FROM part), b AS (SELECT *, CASE WHEN sid LIKE '688%' THEN 2 WHEN sid LIKE '3%' THEN 1 WHEN sid LIKE '4%' OR sid LIKE '8%' THEN 3 ELSE 0 END AS board FROM s) SELECT p_partkey, board::BIGINT AS board, (CASE WHEN board = 2 THEN 200 ELSE 100 END)::BIGINT AS lot, CASE WHEN board = 2 THEN 0.2e0 WHEN board = 1 AND day >= DATE '2020-08-24' THEN 0.2e0 WHEN board = 3 AND day >= DATE '2021-11-15' THEN 0.3e0 ELSE 0.1e0 END AS ratio FROM b")
def tx1_board_lot_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    prefixes = F.array(*[F.lit(x) for x in ("688", "300", "430", "831", "600")])
    sid = F.concat(F.get(prefixes, (F.col("p_partkey") % 5).cast("int")), F.col("p_partkey").cast("string"))
    rows = p.withColumns({"sid": sid, "day": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int"))})
    board = execution.board(F.col("sid"))
    return shown(rows.select("p_partkey", board.alias("board"), execution.lot(F.col("sid")).alias("lot"), execution.price_limit_ratio(board, F.col("day")).alias("ratio")))


@query("SELECT o_orderkey, CASE WHEN (1 + o_custkey % 97) * 100 > o_totalprice THEN 0 ELSE floor(0.3e0 * o_totalprice / ((1 + o_custkey % 97) * 100)) * 100 END::BIGINT AS buy, floor((o_custkey % 997) * 0.3e0)::BIGINT AS sell FROM orders")
def tx3_lot_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = 1 + F.col("o_custkey") % 97
    return o.select("o_orderkey", execution.lot_size_buy(F.col("o_totalprice"), price, F.lit(100), F.lit(0.3)).alias("buy"), execution.lot_size_sell(F.col("o_custkey") % 997, F.lit(0.3)).alias("sell"))


@query(f"{DAYS}SELECT sid, {t()}, {r('1.1e0 * lag(close) OVER s', 'close_rule')}, {r('1.1e0 * (lag(open) OVER s + lag(high) OVER s + lag(low) OVER s + lag(close) OVER s) / 4', 'mean_rule')}, {r('1.1e0 * (lag(high) OVER s + lag(low) OVER s) / 2', 'hl_rule')} FROM bars {S}")
def tx4_reference_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"close_rule": "close", "mean_rule": "mean", "hl_rule": "high-low"}
    return shown(day_bars(spark, sf_dir).withColumns({k: execution.reference_price(F.lit(v), F.lit(0.1)) for k, v in rules.items()}), "sid", "ts", *rules)


_ORD = "o AS (SELECT event_id AS order_id, event_type AS sid, ts AS created_dt, (event_id % 20 + 1) AS size, value * CASE WHEN event_id % 2 = 0 THEN 0.9e0 ELSE 1.1e0 END AS pricelimit, event_id % 2 = 0 AS is_buy FROM events)"
_MET = f"{HOURS}, {_ORD}, met AS (SELECT o.*, b.ts AS bar_ts, b.open, b.high, b.low, b.close, b.volume FROM o JOIN bars b ON b.sid = o.sid AND b.ts::DATE = o.created_dt::DATE AND b.ts >= o.created_dt)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    return e.select(F.col("event_id").alias("order_id"), F.col("event_type").alias("sid"), F.col("ts").alias("created_dt"), (F.col("event_id") % 20 + 1).alias("size"), (F.col("value") * F.when(even, 0.9).otherwise(1.1)).alias("pricelimit"), even.alias("is_buy"))


@query(f"{_MET}, tch AS (SELECT order_id, min(bar_ts) AS touch_ts, arg_min(CASE WHEN is_buy THEN least(open, pricelimit) ELSE greatest(open, pricelimit) END, bar_ts) AS touch_price FROM met WHERE CASE WHEN is_buy THEN low <= pricelimit ELSE high >= pricelimit END GROUP BY order_id) SELECT o.order_id, {t('touch_ts')}, {r('touch_price')} FROM o LEFT JOIN tch USING (order_id)")
def tx5_limit_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(execution.limit_touch(_orders(spark, sf_dir), hour_bars(spark, sf_dir)), "order_id", "touch_ts", "touch_price")


@query(f"{_MET}, c AS (SELECT *, floor(volume * 0.5e0)::BIGINT AS cap FROM met), f AS (SELECT *, least(cap, greatest(0, size - coalesce(sum(cap) OVER (PARTITION BY order_id ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS executed_size FROM c) SELECT order_id, {t('bar_ts', 'executed_dt')}, executed_size, {r('close', 'executed_price')} FROM f WHERE executed_size > 0")
def tx6_capped_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(execution.capped_fills(_orders(spark, sf_dir), hour_bars(spark, sf_dir), 0.5), "order_id", "executed_dt", "executed_size", "executed_price")


@query(f"{HOURS}, dd AS (SELECT sid, ts::DATE AS day, max(high) AS dh, min(low) AS dl FROM bars GROUP BY sid, ts::DATE) SELECT b.sid, {t('b.ts', 'ts')}, {r('CASE WHEN b.high >= dh AND b.high = b.low THEN 0.0e0 WHEN b.high >= dh THEN least((b.high - b.low) / b.low / 0.005e0, 1.0e0) ELSE 1.0e0 END', 'factor')} FROM bars b JOIN dd ON dd.sid = b.sid AND dd.day = b.ts::DATE")
def tx7_locked_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("sid", F.to_date("ts"))
    rows = hour_bars(spark, sf_dir).withColumns({"dh": F.max("high").over(w), "dl": F.min("low").over(w)})
    return shown(rows.select("sid", "ts", execution.locked_factor(F.lit(True), F.col("low"), F.col("high"), F.col("dl"), F.col("dh")).alias("factor")))


@query(f"{DAYS}SELECT sid, {d('ts::DATE', 'day')} FROM bars GROUP BY sid, ts::DATE HAVING (max(high) - min(low)) / min(low) < 0.01e0")
def tx8_flat_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(execution.flat_days(day_bars(spark, sf_dir)))


def _schedule(volume: str) -> str:
    return f"{_MET}, s AS (SELECT *, sum({volume}) OVER (PARTITION BY order_id ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) / sum({volume}) OVER (PARTITION BY order_id) AS share, row_number() OVER (PARTITION BY order_id ORDER BY bar_ts DESC) AS back FROM met), c AS (SELECT *, (CASE WHEN back = 1 THEN size ELSE floor(share * size / 2) * 2 END)::BIGINT AS cum FROM s), z AS (SELECT order_id, bar_ts, cum - coalesce(lag(cum) OVER (PARTITION BY order_id ORDER BY bar_ts), 0) AS target FROM c) SELECT order_id, {t('bar_ts')}, target FROM z WHERE target > 0"


@query(_schedule("volume"))
def tx9_vwap_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(execution.vwap_schedule(_orders(spark, sf_dir), hour_bars(spark, sf_dir), 2), "order_id", "bar_ts", "target")


@query(_schedule("1.0e0"))
def tx10_twap_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(execution.twap_schedule(_orders(spark, sf_dir), hour_bars(spark, sf_dir), 2), "order_id", "bar_ts", "target")


_CARRY = _schedule("volume").replace("WITH ", "WITH RECURSIVE ", 1).replace("WITH RECURSIVE RECURSIVE", "WITH RECURSIVE").rpartition(" SELECT order_id")[0] + ", sl AS (SELECT z.order_id, z.bar_ts, z.target, met.close, row_number() OVER (PARTITION BY z.order_id ORDER BY z.bar_ts) AS i, count(*) OVER (PARTITION BY z.order_id) AS n FROM z JOIN met ON met.order_id = z.order_id AND met.bar_ts = z.bar_ts WHERE z.target > 0), cs AS (SELECT order_id, bar_ts, i, n, target AS held, i = n OR target * close >= 500 AS go FROM sl WHERE i = 1 UNION ALL SELECT sl.order_id, sl.bar_ts, sl.i, sl.n, CASE WHEN cs.go THEN 0 ELSE cs.held END + sl.target, sl.i = sl.n OR (CASE WHEN cs.go THEN 0 ELSE cs.held END + sl.target) * sl.close >= 500 FROM cs JOIN sl ON sl.order_id = cs.order_id AND sl.i = cs.i + 1)"


@query(f"{_CARRY} SELECT order_id, {t('bar_ts')}, held::BIGINT AS target FROM cs WHERE go")
def tx11_carry_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = execution.vwap_schedule(_orders(spark, sf_dir), hour_bars(spark, sf_dir), 2)
    return shown(execution.carry_small(slices, 500.0, tie=()), "order_id", "bar_ts", "target")


@query(f"{_MET.replace(', met AS', ', dd AS (SELECT sid AS dsid, ts::DATE AS day, max(high) AS dh, min(low) AS dl FROM bars GROUP BY sid, ts::DATE), met AS')} SELECT order_id, {t('bar_ts')}, {r('greatest(least(CASE WHEN is_buy THEN close * 1.01e0 ELSE close * 0.99e0 END, dh), dl)', 'price')} FROM met JOIN dd ON dsid = sid AND day = bar_ts::DATE")
def tx12_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("sid", F.to_date("ts"))
    bars = hour_bars(spark, sf_dir).withColumns({"dh": F.max("high").over(w), "dl": F.min("low").over(w)})
    met = execution.bars_met(_orders(spark, sf_dir), bars)
    return shown(met.withColumn("price", execution.slip(F.col("bar_close"), F.col("is_buy"), F.col("bar_dl"), F.col("bar_dh"), percent=0.01)), "order_id", "bar_ts", "price")


@query(f"WITH {_FILLS} SELECT order_id, {r("(CASE WHEN is_buy THEN 0 ELSE 0.001e0 END + CASE WHEN sid % 2 = 0 THEN 0.0001e0 ELSE 0 END + CASE WHEN executed_dt < TIMESTAMP '2015-06-09' THEN 0.003e0 ELSE 0.0005e0 END) * q * p", 'stock')}, {r('q * p * 0.002e0', 'percent')}, {r('q * 0.5e0', 'fixed')}, {r('30 * 0.05e0 / 365 * q * p', 'interest')} FROM fills")
def tx13_commission(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("executed_size"), F.col("executed_price")
    return shown(_fills(spark, sf_dir).select(
        "order_id", execution.stock_commission(q, p, F.col("is_buy"), F.to_date("executed_dt"), F.col("sid") % 2 == 0).alias("stock"), execution.commission(q, p, percent=0.002).alias("percent"),
        execution.commission(q, p, fixed=0.5).alias("fixed"), execution.holding_interest(q, p, F.lit(30), 0.05).alias("interest"),
    ))


@query("WITH f AS (SELECT l_orderkey AS order_id, sum(l_quantity)::BIGINT AS filled FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey AS order_id, (60 + o_orderkey % 240) AS size FROM orders) SELECT o.order_id, coalesce(filled, 0) AS filled, CASE WHEN coalesce(filled, 0) >= size THEN 'completed' WHEN coalesce(filled, 0) > 0 THEN 'partial' ELSE 'open' END AS status FROM o LEFT JOIN f USING (order_id)")
def tx26_order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("long").alias("executed_size"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (60 + F.col("o_orderkey") % 240).alias("size"))
    return execution.order_status(orders, fills).select("order_id", "filled", "status")


@query("WITH f AS (SELECT l_orderkey AS order_id, sum(l_quantity)::BIGINT AS done FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS order_id, (60 + o_orderkey % 240) - coalesce(done, 0) AS remaining FROM orders LEFT JOIN f ON f.order_id = o_orderkey WHERE (60 + o_orderkey % 240) - coalesce(done, 0) > 0")
def al7_pending_sells(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("long").alias("executed_size"))
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (60 + F.col("o_orderkey") % 240).alias("size"))
    return allocate.pending_sells(planned, fills).select("order_id", "remaining")


# --- ledgers ------------------------------------------------------------------------------------

_LED = f"WITH RECURSIVE {_FILLS}, n AS (SELECT *, row_number() OVER w AS i, sum(CASE WHEN is_buy THEN q ELSE -q END) OVER (PARTITION BY experiment_id, sid ORDER BY executed_dt, order_id ROWS UNBOUNDED PRECEDING)::BIGINT AS size_after FROM fills WINDOW w AS (PARTITION BY experiment_id, sid ORDER BY executed_dt, order_id))"


@query(f"{_LED}, c AS (SELECT experiment_id, sid, i, order_id, size_after, CASE WHEN is_buy THEN p ELSE 0.0e0 END AS cost FROM n WHERE i = 1 UNION ALL SELECT n.experiment_id, n.sid, n.i, n.order_id, n.size_after, CASE WHEN n.size_after = 0 THEN 0.0e0 WHEN n.is_buy AND n.size_after - n.q <= 0 THEN n.p WHEN n.is_buy THEN (c.cost * (n.size_after - n.q) + n.p * n.q) / n.size_after ELSE c.cost END FROM c JOIN n ON n.experiment_id = c.experiment_id AND n.sid = c.sid AND n.i = c.i + 1) SELECT experiment_id, sid, order_id, size_after, {r('cost', 'cost_basis')} FROM c")
def tx15_position_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ledger.position_ledger(_fills(spark, sf_dir)), "experiment_id", "sid", "order_id", "size_after", "cost_basis")


@query(f"WITH {_FILLS}, a AS (SELECT x.order_id, x.experiment_id, x.sid, x.is_buy, coalesce(sum(CASE WHEN y.is_buy AND y.executed_dt < x.executed_dt THEN y.q END), 0) - coalesce(sum(CASE WHEN NOT y.is_buy AND (y.executed_dt, y.order_id) <= (x.executed_dt, x.order_id) THEN y.q END), 0) AS available FROM fills x JOIN fills y ON x.experiment_id = y.experiment_id AND x.sid = y.sid GROUP BY x.order_id, x.experiment_id, x.sid, x.is_buy) SELECT order_id, available::BIGINT AS available, (NOT is_buy) AND available < 0 AS oversold FROM a")
def tx16_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.availability(_fills(spark, sf_dir))
    return rows.select("order_id", "available", ((~F.col("is_buy")) & (F.col("available") < 0)).alias("oversold"))


_POS = f"{DAYS}, pos AS (SELECT o_custkey % 100 AS sid, o_orderdate AS day, o_orderkey AS id, 1 + o_orderkey % 50 AS size, 1000.0e0 + o_orderkey % 3000 AS cost FROM orders)"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 100).alias("sid"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 50).alias("size"), (1000.0 + F.col("o_orderkey") % 3000).alias("cost_basis"))


@query(f"{_POS}, m AS (SELECT p.id, any_value(p.size) AS size, any_value(p.cost) AS cost, arg_max(b.close, b.ts) AS close FROM pos p LEFT JOIN bars b ON b.sid = p.sid AND b.ts <= p.day GROUP BY p.id) SELECT id, {r('close')}, {r('coalesce(size * (close - cost), 0)', 'pnl')} FROM m")
def tx18_mark_to_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = day_bars(spark, sf_dir).select("sid", F.col("ts").alias("day"), "close")
    return shown(ledger.mark_to_close(_positions(spark, sf_dir), closes), "id", "close", "pnl")


_K = "(1 + CASE WHEN sid % 3 = 0 THEN 0.5e0 ELSE 0 END)"


@query(f"{_POS.replace(DAYS + ', ', 'WITH ')} SELECT id, floor(size * {_K})::BIGINT AS size, {r(f'cost / {_K}', 'cost_basis')}, {r('CASE WHEN sid % 3 = 0 THEN size * 2.0e0 / 10 ELSE 0 END', 'cash_in')} FROM pos")
def tx19_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = _positions(spark, sf_dir)
    events = pos.where("sid % 3 = 0").select("sid", "day").distinct().select("sid", "day", F.lit(3.0).alias("bonus_share"), F.lit(2.0).alias("transfer"), F.lit(2.0).alias("bonus"))
    return shown(ledger.apply_bonus(pos, events), "id", "size", "cost_basis", "cash_in")


@query(f"{_POS.replace(DAYS + ', ', 'WITH ')} SELECT id, floor(size * CASE WHEN sid % 4 = 0 THEN 1.3e0 ELSE 1 END)::BIGINT AS size, {r('CASE WHEN sid % 4 = 0 THEN (cost + 0.3e0 * 5) / 1.3e0 ELSE cost END', 'cost_basis')}, {r('CASE WHEN sid % 4 = 0 THEN -size * 0.3e0 * 5 ELSE 0 END', 'cash_in')} FROM pos")
def tx20_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = _positions(spark, sf_dir)
    rights = pos.where("sid % 4 = 0").select("sid", "day").distinct().select("sid", "day", F.lit(3.0).alias("ratio"), F.lit(5.0).alias("price"))
    return shown(ledger.apply_rights(pos, rights), "id", "size", "cost_basis", "cash_in")


@query("WITH pos AS (SELECT o_custkey % 100 AS sid, o_orderdate AS day, o_orderkey AS id, 1 + o_orderkey % 50 AS size, 1000.0e0 + o_orderkey % 3000 AS cost FROM orders) SELECT id, CASE WHEN sid % 5 = 0 AND day >= TIMESTAMP '1998-01-01' AND sid % 2 = 0 THEN 'M' || sid ELSE sid::VARCHAR END AS sid, (CASE WHEN sid % 5 = 0 AND day >= TIMESTAMP '1998-01-01' THEN CASE WHEN sid % 2 = 0 THEN floor(size * 1.5e0) ELSE 0 END ELSE size END)::BIGINT AS size, " + r("CASE WHEN sid % 5 = 0 AND day >= TIMESTAMP '1998-01-01' AND sid % 2 = 0 THEN 3000 / 1.5e0 ELSE cost END", "cost_basis") + " FROM pos")
def tx21_mergers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = _positions(spark, sf_dir).withColumns({"sid": F.col("sid").cast("string"), "close": F.lit(3000.0)})
    n = F.col("s_suppkey")
    dim = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(n.cast("string").alias("sid"), F.lit("1998-01-01").cast("timestamp").alias("delist"), F.when(n % 2 == 0, F.concat(F.lit("M"), n.cast("string"))).alias("merger"), F.lit(1.5).alias("ratio"))
    return shown(ledger.apply_mergers(pos, dim), "id", "sid", "size", "cost_basis")


@query(f"WITH {_FILLS}, m AS (SELECT experiment_id, sid, sum(CASE WHEN is_buy THEN q ELSE -q END)::BIGINT AS size, sum(CASE WHEN is_buy THEN q ELSE -q END * p) AS paid FROM fills GROUP BY experiment_id, sid) SELECT experiment_id, sid, size, {r('paid / size', 'cost_basis')} FROM m WHERE size <> 0")
def tx22_merge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fills(spark, sf_dir).select("experiment_id", "sid", F.when(F.col("is_buy"), F.col("executed_size")).otherwise(-F.col("executed_size")).alias("size"), F.col("executed_price").alias("cost_basis"))
    return shown(ledger.drop_flat(ledger.merge_positions(f)), "experiment_id", "sid", "size", "cost_basis")


@query(f"WITH {_FILLS} SELECT experiment_id, order_id::VARCHAR AS ref, {r('1000000 + sum(CASE WHEN is_buy THEN -q * p ELSE q * p END - comm) OVER (PARTITION BY experiment_id ORDER BY executed_dt, order_id::VARCHAR ROWS UNBOUNDED PRECEDING)', 'cash').replace('+ 3e-08, 6)', '+ 0.0013, 2)')} FROM fills")
def tx24_cash_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    cash = ledger.cash_ledger(_fills(spark, sf_dir), 1_000_000.0)
    return cash.select("experiment_id", "ref", (F.round(F.col("cash") + F.lit(0.0013), 2) + F.lit(0.0)).alias("cash"))


@query(f"WITH {_FILLS}, l AS (SELECT experiment_id, executed_dt AS ts, order_id::VARCHAR AS ref, CASE WHEN is_buy THEN -q * p ELSE q * p END - comm AS amount FROM fills UNION ALL SELECT o_custkey % 50, o_orderdate, NULL, o_totalprice / 8 FROM orders WHERE o_orderstatus = 'F') SELECT experiment_id, {t()}, coalesce(ref, '') AS ref, {r('amount')}, round(1000000 + sum(amount) OVER (PARTITION BY experiment_id ORDER BY ts, ref NULLS FIRST, amount ROWS UNBOUNDED PRECEDING) + 0.0013, 2) + 0.0e0 AS cash FROM l")
def tx24_cash_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash after every fill and every payment from outside, those of a time before its fills."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    events = o.select((F.col("o_custkey") % 50).alias("experiment_id"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 8).alias("amount"))
    out = ledger.cash_ledger(_fills(spark, sf_dir), 1_000_000.0, events)
    near = F.round(F.col("cash") + F.lit(0.0013), 2)
    return shown(out, "experiment_id", "ts", F.coalesce("ref", F.lit("")).alias("ref"), "amount", near.alias("cash"))


@query(f"{_POS.replace(DAYS + ', ', 'WITH ')} SELECT sid AS experiment_id, {d('day')}, {r('sum(size * cost + size * 2)', 'portfolio_value')}, {r('sum(size * 2.0e0)', 'pnl')} FROM pos GROUP BY sid, day")
def tx25_account_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = _positions(spark, sf_dir).withColumns({"pnl": F.col("size") * 2.0, "day": F.to_date("day")}).withColumnRenamed("sid", "experiment_id")
    return shown(ledger.account_value(pos))


# --- performance: a supplier's month closes as an equity curve -------------------------------------------

# --- ledgers that need the last step: ignored sells, corporate actions --------------------

_STRICT = f"WITH RECURSIVE {_FILLS}, n AS (SELECT *, executed_dt::DATE AS day, row_number() OVER (PARTITION BY experiment_id, sid ORDER BY executed_dt, order_id) AS i FROM fills), st AS (SELECT experiment_id, sid, 0::BIGINT AS i, 0::BIGINT AS order_id, NULL::DATE AS day, FALSE AS ignored, 0::BIGINT AS size, 0::BIGINT AS available, NULL::DOUBLE AS cost FROM n WHERE i = 1 UNION ALL SELECT n.experiment_id, n.sid, n.i, n.order_id, n.day, x.ignored, x.size, x.free - CASE WHEN n.is_buy OR x.ignored THEN 0 ELSE n.q END, CASE WHEN x.size = 0 THEN NULL WHEN NOT n.is_buy THEN st.cost WHEN st.size = 0 THEN n.p ELSE (st.cost * st.size + n.p * n.q) / (st.size + n.q) END FROM st JOIN n ON n.experiment_id = st.experiment_id AND n.sid = st.sid AND n.i = st.i + 1, LATERAL (SELECT CASE WHEN n.day IS DISTINCT FROM st.day THEN st.size ELSE st.available END AS free, NOT n.is_buy AND n.q > free AS ignored, st.size + CASE WHEN n.is_buy THEN n.q WHEN ignored THEN 0 ELSE -n.q END AS size) x)"


@query(f"{_STRICT} SELECT experiment_id, sid, order_id, ignored, size AS size_after, available AS available_after, {r('cost', 'cost_basis')} FROM st WHERE i > 0")
def tx17_strict_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fill, with sells of more than is available ignored; an ignored sell lowers nothing."""
    return shown(ledger.strict_ledger(_fills(spark, sf_dir)), "experiment_id", "sid", "order_id", "ignored", "size_after", "available_after", "cost_basis")


# series 1 and 2, 4 and 5, ... merge into 3, 6, ... one after the other; some of these end without a target
_ENDS = "SELECT s_suppkey AS sid, CASE WHEN s_suppkey % 3 = 1 THEN DATE '1997-06-30' WHEN s_suppkey % 3 = 2 THEN DATE '1999-03-31' ELSE DATE '2000-06-30' END AS delist, s_suppkey % 3 <> 0 AS moves, CASE WHEN s_suppkey % 3 = 1 THEN 1.5e0 ELSE 0.7e0 END AS ratio FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 7 = 0"
_EVENTS_LOG = f"{DAYS}, {_FILLS}, ends AS ({_ENDS}), closes AS (SELECT e.sid, arg_max(b.close, b.ts) AS close FROM ends e JOIN bars b ON b.sid = e.sid AND b.ts::DATE <= e.delist GROUP BY e.sid), ev AS (SELECT s_suppkey AS sid, DATE '1996-07-01' + (s_suppkey % 30)::INT AS day, 0 AS kind, NULL::DOUBLE AS close, 0.0e0 AS ratio, FALSE AS moves FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, DATE '1998-02-01' + (s_suppkey % 20)::INT, 1, NULL, 0, FALSE FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT e.sid, delist, 3, c.close, ratio, moves FROM ends e LEFT JOIN closes c ON c.sid = e.sid), who AS (SELECT DISTINCT experiment_id, (sid + 2) // 3 AS fam FROM fills), l AS (SELECT experiment_id, (sid + 2) // 3 AS fam, (sid + 2) % 3 + 1 AS slot, executed_dt::DATE AS day, 2 AS kind, executed_dt AS stamp, order_id, is_buy, q, p, NULL::DOUBLE AS close, 0.0e0 AS ratio, FALSE AS moves FROM fills UNION ALL SELECT experiment_id, fam, (sid + 2) % 3 + 1, day, kind, NULL, NULL, NULL, NULL, NULL, close, ratio, moves FROM ev JOIN who ON fam = (sid + 2) // 3), n AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, fam ORDER BY day, kind, CASE WHEN kind = 3 THEN slot END, stamp NULLS FIRST, order_id NULLS FIRST, slot) AS i FROM l)"
_EVENTS_STEP = f"{_EVENTS_LOG}, st AS (SELECT experiment_id, fam, 0::BIGINT AS i, NULL::DATE AS day, [0, 0, 0]::BIGINT[] AS size, [0, 0, 0]::BIGINT[] AS free, [NULL, NULL, NULL]::DOUBLE[] AS cost, 0::BIGINT AS slot, 2 AS kind, NULL::BIGINT AS order_id, FALSE AS ignored, 0::BIGINT AS had, 0.0e0 AS cash, FALSE AS moved FROM who UNION ALL SELECT n.experiment_id, n.fam, n.i, n.day, [CASE WHEN j = n.slot THEN z.size WHEN z.moved AND j = n.slot + 1 THEN st.size[j] + z.m ELSE st.size[j] END for j in [1, 2, 3]], [CASE WHEN j = n.slot THEN z.free WHEN z.moved AND j = n.slot + 1 THEN x.free[j] + z.m ELSE x.free[j] END for j in [1, 2, 3]], [CASE WHEN j = n.slot THEN z.cost WHEN z.moved AND j = n.slot + 1 THEN (st.size[j] * coalesce(st.cost[j], 0) + z.m * coalesce(n.close / n.ratio, y.c / n.ratio)) / (st.size[j] + z.m) ELSE st.cost[j] END for j in [1, 2, 3]], n.slot, n.kind, n.order_id, y.ignored, y.s, z.cash, z.moved FROM st JOIN n ON n.experiment_id = st.experiment_id AND n.fam = st.fam AND n.i = st.i + 1, LATERAL (SELECT CASE WHEN n.day IS DISTINCT FROM st.day THEN st.size ELSE st.free END AS free) x, LATERAL (SELECT st.size[n.slot] AS s, x.free[n.slot] AS a, st.cost[n.slot] AS c, n.kind = 2 AND NOT n.is_buy AND n.q > x.free[n.slot] AS ignored) y, LATERAL (SELECT (CASE WHEN n.kind = 0 THEN floor(y.s * 1.5e0) WHEN n.kind = 1 THEN floor(y.s * 1.3e0) WHEN n.kind = 3 THEN 0 WHEN n.is_buy THEN y.s + n.q WHEN y.ignored THEN y.s ELSE y.s - n.q END)::BIGINT AS size, (CASE WHEN n.moves THEN floor(y.s * n.ratio) ELSE 0 END)::BIGINT AS m) v, LATERAL (SELECT v.size AS size, v.m AS m, (CASE WHEN n.kind = 0 THEN floor(y.a * 1.5e0) WHEN n.kind = 3 THEN 0 WHEN n.kind = 1 OR n.is_buy OR y.ignored THEN y.a ELSE y.a - n.q END)::BIGINT AS free, CASE WHEN v.size = 0 THEN NULL WHEN n.kind = 0 THEN y.c / 1.5e0 WHEN n.kind = 1 THEN (y.c + 0.3e0 * 500) / 1.3e0 WHEN n.is_buy THEN CASE WHEN y.s <= 0 THEN n.p ELSE (y.c * y.s + n.p * n.q) / (y.s + n.q) END ELSE y.c END AS cost, CASE WHEN n.kind = 0 THEN y.s * 0.2e0 WHEN n.kind = 1 THEN -y.s * 0.3e0 * 500 WHEN n.kind = 3 OR y.ignored THEN 0 WHEN n.is_buy THEN -n.p * n.q ELSE n.p * n.q END AS cash, v.m > 0 AS moved) z)"


@query(f"{_EVENTS_STEP} SELECT experiment_id, fam * 3 - 3 + slot AS sid, {d('day')}, CASE kind WHEN 0 THEN 'bonus' WHEN 1 THEN 'rights' WHEN 3 THEN 'ended' ELSE CASE WHEN ignored THEN 'ignored' ELSE 'fill' END END AS action, order_id, size[slot] AS size_after, free[slot] AS available_after, {r('cost[slot]', 'cost_basis')}, {r('cash')} FROM st WHERE i > 0 AND (kind = 2 OR had > 0) UNION ALL SELECT experiment_id, fam * 3 - 2 + slot, {d('day')}, 'merged', NULL, size[slot + 1], free[slot + 1], {r('cost[slot + 1]', 'cost_basis')}, 0 FROM st WHERE i > 0 AND kind = 3 AND moved")
def tx19_positions_through_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions carried through bonus shares, rights, chains of two mergers and delistings."""
    n = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", n.alias("sid"))

    def day(text: str, more: Column) -> Column:
        return F.date_add(F.lit(text).cast("date"), more.cast("int")).alias("day")

    bonus = s.where("s_suppkey % 2 = 0").select("sid", day("1996-07-01", n % 30), F.lit(3.0).alias("bonus_share"), F.lit(2.0).alias("transfer"), F.lit(2.0).alias("bonus"))
    rights = s.where("s_suppkey % 4 = 0").select("sid", day("1998-02-01", n % 20), F.lit(3.0).alias("ratio"), F.lit(500.0).alias("price"))
    ends = F.when(n % 3 == 1, "1997-06-30").when(n % 3 == 2, "1999-03-31").otherwise("2000-06-30").cast("date")
    instruments = s.where("s_suppkey % 3 <> 0 OR s_suppkey % 7 = 0").select("sid", ends.alias("delist"), F.when(n % 3 != 0, n + 1).alias("merger"), F.when(n % 3 == 1, 1.5).otherwise(0.7).alias("ratio"))
    closes = day_bars(spark, sf_dir).select("sid", F.to_date("ts").alias("day"), "close")
    out = ledger.positions_through_events(_fills(spark, sf_dir), bonus, rights, instruments, closes)
    return shown(out, "experiment_id", "sid", "day", "action", "order_id", "size_after", "available_after", "cost_basis", "cash")


_EQ = f"{MONTHS}, eq AS (SELECT sid, ts, close AS value, row_number() OVER (PARTITION BY sid ORDER BY ts) AS n FROM bars)"


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_bars(spark, sf_dir).select("sid", "ts", F.col("close").alias("value"))


_BY = {"by": ("sid",), "order": ("ts",)}


@query(f"{_EQ} SELECT sid, {t()}, {r('value / lag(value) OVER s - 1', 'ret')}, {r(f'value / first_value(value) OVER {UPTO} - 1', 'cum_ret')}, {r(f'CASE WHEN n >= 12 THEN pow(value / first_value(value) OVER {UPTO}, 12.0e0 / n) - 1 END', 'ann_ret')} FROM eq WHERE n > 0 {S}")
def pf1_time_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performance.time_return(_equity(spark, sf_dir), "months", **_BY)
    late = F.row_number().over(W.partitionBy("sid").orderBy("ts")) >= 12
    return shown(rows.withColumn("ann_ret", F.when(late, F.col("ann_ret"))), "sid", "ts", "ret", "cum_ret", "ann_ret")


_DD = f"{_EQ}, pk AS (SELECT *, max(value) OVER {UPTO} AS peak, value / first_value(value) OVER {UPTO} AS g FROM eq), dd AS (SELECT *, (peak - value) / peak AS drawdown, n - last_value(CASE WHEN value = peak THEN n END IGNORE NULLS) OVER {UPTO} AS dd_len FROM pk), mx AS (SELECT *, max(drawdown) OVER {UPTO} AS max_drawdown, max(dd_len) OVER {UPTO} AS max_dd_len FROM dd)"


@query(f"{_DD} SELECT sid, {t()}, {r('drawdown')}, dd_len, {r('max_drawdown')}, max_dd_len, {r('CASE WHEN max_drawdown = 0 THEN 0 ELSE (pow(g, 12.0e0 / n) - 1) / max_drawdown END', 'calmar')}, {r(f'CASE WHEN max_drawdown = 0 THEN 0 ELSE ln(value / first_value(value) OVER {last(36)}) / count(*) OVER {last(36)} / max_drawdown END', 'calmar_log')} FROM mx")
def pf2_drawdown_calmar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performance.calmar(performance.calmar_log(_equity(spark, sf_dir), **_BY).select("sid", "ts", "value", "calmar_log"), "months", **_BY)
    return shown(rows.withColumns({c: F.col(c).cast("long") for c in ("dd_len", "max_dd_len")}), "sid", "ts", "drawdown", "dd_len", "max_drawdown", "max_dd_len", "calmar", "calmar_log")


_RET = f"{_EQ}, rt AS (SELECT sid, ts, value / lag(value) OVER (PARTITION BY sid ORDER BY ts) - 1 AS ret FROM eq)"


@query(f"{_RET}, e AS (SELECT *, ret - (pow(1.01e0, 1.0e0 / 12) - 1) AS e FROM rt) SELECT sid, {t()}, {r(f'CASE WHEN count(e) OVER {UPTO} > 1 AND stddev_samp(e) OVER {UPTO} > 1e-12 THEN avg(e) OVER {UPTO} / stddev_samp(e) OVER {UPTO} * sqrt(12.0e0) END', 'sharpe')} FROM e")
def pf5_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.sharpe(performance.time_return(_equity(spark, sf_dir), "months", **_BY), unit="months", **_BY), "sid", "ts", "sharpe")


@query(f"{_RET} SELECT sid, {t()}, {r(f'avg(ret) OVER {UPTO}', 'average')}, {r(f'stddev_pop(ret) OVER {UPTO}', 'stddev')}, count(*) FILTER (WHERE ret > 0) OVER {UPTO} AS positive, count(*) FILTER (WHERE ret < 0) OVER {UPTO} AS negative, {r(f'max(ret) OVER {UPTO}', 'best')}, {r(f'min(ret) OVER {UPTO}', 'worst')} FROM rt")
def pf6_period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performance.period_stats(performance.time_return(_equity(spark, sf_dir), "months", **_BY), **_BY)
    return shown(rows, "sid", "ts", "average", "stddev", "positive", "negative", "best", "worst")


_ALT = _FILLS.replace("l.l_quantity::BIGINT AS q", "10::BIGINT AS q").replace("l.l_returnflag <> 'R' AS is_buy", "(row_number() OVER (PARTITION BY o.o_custkey % 50, l.l_suppkey ORDER BY l.l_shipdate, l.l_orderkey * 10000000000 + l.l_linenumber::BIGINT * 1000000000 + l.l_partkey)) % 3 = 1 AS is_buy")
_CLOSED = f"WITH {_ALT}, z AS (SELECT *, CASE WHEN is_buy THEN q * 2 ELSE -q END AS sq FROM fills), u AS (SELECT *, sum(sq) OVER w AS sz FROM z WINDOW w AS (PARTITION BY experiment_id, sid ORDER BY executed_dt, order_id ROWS UNBOUNDED PRECEDING)), g AS (SELECT *, coalesce(sum((sz = 0)::INT) OVER (PARTITION BY experiment_id, sid ORDER BY executed_dt, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS round FROM u), c AS (SELECT experiment_id, sid, round, min(executed_dt) AS opened, max(executed_dt) AS closed, count(*) AS trades, sum(-sq * p - comm) AS pnl FROM g GROUP BY experiment_id, sid, round HAVING max((sz = 0)::INT) = 1)"


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("experiment_id", "sid").orderBy("executed_dt", "order_id"))
    f = _fills(spark, sf_dir).withColumn("is_buy", n % 3 == 1)
    return performance.closed_positions(f.withColumn("executed_size", F.when(F.col("is_buy"), 20).otherwise(10).cast("long")))


@query(f"{_CLOSED} SELECT experiment_id, sid, round, {t('opened')}, {t('closed')}, trades, {r('pnl')}, date_diff('day', opened::DATE, closed::DATE) AS days FROM c")
def pf7_closed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_closed(spark, sf_dir), "experiment_id", "sid", "round", "opened", "closed", "trades", "pnl", "days")


@query(f"{_CLOSED}, k AS (SELECT experiment_id, closed::DATE AS day, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, sum(date_diff('day', opened::DATE, closed::DATE)) AS days, sum(pnl) AS pnl FROM c GROUP BY experiment_id, closed::DATE) SELECT experiment_id, {d('day')}, n, {r('wins / n::DOUBLE', 'win_rate')}, {r('(sum(wins) OVER v)::DOUBLE / sum(n) OVER v', 'cum_win_rate')}, {r('(sum(days) OVER v)::DOUBLE / sum(n) OVER v', 'avg_days')}, (sum(n) OVER v)::BIGINT AS cum_n FROM k WINDOW v AS (PARTITION BY experiment_id ORDER BY day ROWS UNBOUNDED PRECEDING)")
def pf7_closed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.closed_stats(_closed(spark, sf_dir)), "experiment_id", "day", "n", "win_rate", "cum_win_rate", "avg_days", "cum_n")


@query(f"{_CLOSED} SELECT experiment_id, sid, round, {r('CASE WHEN stddev_samp(pnl) OVER v <> 0 THEN sqrt(count(pnl) OVER v) * avg(pnl) OVER v / stddev_samp(pnl) OVER v END', 'sqn')} FROM c WINDOW v AS (PARTITION BY experiment_id ORDER BY closed, sid, round ROWS UNBOUNDED PRECEDING)")
def pf8_sqn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.sqn(_closed(spark, sf_dir)), "experiment_id", "sid", "round", "sqn")


@query("SELECT event_type AS experiment_id, strftime(ts, '%Y-%m-%d') AS day, (hour(ts) * 60 + minute(ts)) // 30 AS slot, count(*) AS n_orders FROM events GROUP BY ALL")
def pf9_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("experiment_id"), F.col("ts").alias("created_dt"))
    return shown(performance.order_counts(e, 30))


@query("SELECT event_id AS order_id, count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_trades FROM events")
def pf10_running_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("experiment_id"), F.col("ts").alias("executed_dt"), F.col("event_id").alias("order_id"))
    return performance.running_trades(e).select("order_id", "n_trades")


@query(f"{DAYS}, bm AS (SELECT ts::DATE AS day, avg(close) AS close FROM bars GROUP BY ts::DATE) SELECT {d('day')}, {r('coalesce(close / lag(close) OVER (ORDER BY day) - 1, 0)', 'ret')} FROM bm")
def pf12_benchmark_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.benchmark_returns(day_bars(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.avg("close").alias("close"))))


@query(f"{DAYS} SELECT sid, {r('avg(close)', 'mean')}, {r('stddev_samp(close)', 'deviation')} FROM bars GROUP BY sid")
def pf13_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.moments(day_bars(spark, sf_dir), "close", ("sid",), bessel=True), "sid", "mean", "deviation")


@query(f"{DAYS} SELECT sid, {t()}, {r(f'100 * close / first_value(close) OVER {UPTO}', 'buy_and_hold')} FROM bars")
def pf14_buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(performance.buy_and_hold(day_bars(spark, sf_dir), 100.0), "sid", "ts", "buy_and_hold")


_PLAN = (
    "WITH li AS (SELECT *, date_trunc('month', l_shipdate)::DATE AS day, l_extendedprice / l_quantity AS price FROM lineitem), sc AS (SELECT day, l_partkey AS sid, sum(l_extendedprice) AS score FROM li GROUP BY day, l_partkey), rk AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, sid) AS rank FROM sc QUALIFY rank <= 20), "
    "h AS (SELECT l_suppkey AS experiment_id, day, l_partkey AS sid, min(price) AS price, max(price * (1 + l_discount * 2)) AS cost_basis, max(dayofmonth(l_shipdate)) AS days_held FROM li WHERE l_linenumber = 1 GROUP BY l_suppkey, day, l_partkey), ac AS (SELECT l_suppkey AS experiment_id, day, max(l_discount) * 2 AS drawdown, sum(l_extendedprice) AS cash FROM li GROUP BY l_suppkey, day), "
    "j AS (SELECT h.*, CASE WHEN ac.drawdown >= 0.2 THEN 'drawdown' WHEN h.price / h.cost_basis <= 0.9 THEN 'stop' WHEN h.days_held >= 4 AND rk.rank IS NULL THEN 'expired' END AS reason FROM h JOIN ac ON ac.experiment_id = h.experiment_id AND ac.day = h.day LEFT JOIN rk ON rk.day = h.day AND rk.sid = h.sid), "
    "n AS (SELECT experiment_id, day, count(*) AS held, count(reason) AS sold FROM j GROUP BY experiment_id, day), free AS (SELECT ac.experiment_id, ac.day, 10 - coalesce(held, 0) + coalesce(sold, 0) AS free FROM ac LEFT JOIN n ON n.experiment_id = ac.experiment_id AND n.day = ac.day WHERE drawdown < 0.2 AND cash > 10000), "
    "b AS (SELECT f.experiment_id, f.day, rk.sid, f.free, row_number() OVER (PARTITION BY f.experiment_id, f.day ORDER BY rk.rank, rk.sid) AS turn FROM free f JOIN rk ON rk.day = f.day WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.experiment_id = f.experiment_id AND h.day = f.day AND h.sid = rk.sid))"
)


@query(f"{_PLAN} SELECT experiment_id, {d('day')}, sid, 'sell' AS action, reason, (CASE WHEN reason = 'stop' THEN 0 ELSE 1 END)::BIGINT AS priority FROM j WHERE reason IS NOT NULL UNION ALL SELECT experiment_id, {d('day')}, sid, 'buy', 'ranked', (turn + 1)::BIGINT FROM b WHERE turn <= free")
def al6_rebalance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for every supplier book and month: held parts against the month's best scores."""
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date(F.date_trunc("month", "l_shipdate")))
    scores = li.groupBy("day", F.col("l_partkey").alias("sid")).agg(F.sum("l_extendedprice").alias("score"))
    ranked = allocate.daily_top_k(scores, 20)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    held = li.where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("experiment_id"), "day", F.col("l_partkey").alias("sid")).agg(F.min(price).alias("price"), F.max(price * (1 + F.col("l_discount") * 2)).alias("cost_basis"), F.max(F.dayofmonth("l_shipdate")).alias("days_held"))
    accounts = li.groupBy(F.col("l_suppkey").alias("experiment_id"), "day").agg((F.max("l_discount") * 2).alias("drawdown"), F.sum("l_extendedprice").alias("cash"))
    return shown(allocate.rebalance_plan(held, ranked, accounts, slots=10))
