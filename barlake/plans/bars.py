"""Queries of sources, bar building, filters, fillers, calendars and alignment."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import period_end
from ..operators import align, calendar, fill, resample
from ..sources import bars as src
from ..sources import sinks
from .base import DAYS, EVENTS, HOURS, MONTHS, OHLC, S, TICKS, UPTO, d, day_bars, edge, event_ticks, hour_bars, month_bars, query, r, shown, t, table, ticks

# --- bar building ---------------------------------------------------------------


@query(f"{HOURS}SELECT sid, {t()}, {OHLC} FROM bars")
def rs1_hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(hour_bars(spark, sf_dir))


@query(f"WITH ticks AS ({EVENTS}), k AS (SELECT sid, {edge('ts', 900)} AS e, arg_min(price, (ts, tb)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tb)) AS close, sum(volume) AS volume FROM ticks GROUP BY sid, {edge('ts', 900)}) SELECT sid, {t('e - INTERVAL 15 MINUTE', 'ts')}, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('volume')} FROM k")
def rs2_left_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = resample.resample(src.ticks_as_bars(event_ticks(spark, sf_dir)), "minutes", 15, tie=("tb",), right_edge=False)
    return shown(bars, "sid", "ts", "open", "high", "low", "close", "volume")


_CUT = f"CASE WHEN strftime(ts, '%H:%M:%S') < '15:00:00' OR ts = date_trunc('day', ts) + INTERVAL 15 HOUR THEN least({edge('ts', 7200)}, date_trunc('day', ts) + INTERVAL 15 HOUR) ELSE {edge('ts', 7200)} END"


@query(f"WITH ticks AS ({EVENTS}), k AS (SELECT *, {_CUT} AS e FROM ticks) SELECT sid, {t('e', 'ts')}, {r('arg_min(price, (ts, tb))', 'open')}, {r('max(price)', 'high')}, {r('min(price)', 'low')}, {r('arg_max(price, (ts, tb))', 'close')}, {r('sum(volume)', 'volume')} FROM k GROUP BY sid, e")
def rs3_session_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = resample.resample(src.ticks_as_bars(event_ticks(spark, sf_dir)), "hours", 2, tie=("tb",), session_end="15:00:00")
    return shown(bars, "sid", "ts", "open", "high", "low", "close", "volume")


@query(f"{DAYS}SELECT sid, {t('ts + INTERVAL 15 HOUR', 'ts')}, {OHLC} FROM bars")
def rs4_day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resample.resample(src.ticks_as_bars(ticks(spark, sf_dir)), "days", tie=("tb",), session_end="15:00:00"))


def _period(unit: str) -> str:
    return MONTHS.replace("date_trunc('month', ts)", f"date_trunc('{unit}', ts)") + f"SELECT sid, {t()}, {OHLC} FROM bars"


@query(_period("week"))
def rs5_week_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resample.preset(src.ticks_as_bars(ticks(spark, sf_dir)), "weekly", tie=("tb",)))


@query(_period("month"))
def rs6_month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(month_bars(spark, sf_dir))


@query(_period("year"))
def rs7_year_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resample.preset(src.ticks_as_bars(ticks(spark, sf_dir)), "yearly", tie=("tb",)))


@query(f"WITH ticks AS ({EVENTS}), k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, tb) AS n FROM ticks) SELECT sid, {t('max(ts)', 'ts')}, {r('arg_min(price, n)', 'open')}, {r('max(price)', 'high')}, {r('min(price)', 'low')}, {r('arg_max(price, n)', 'close')}, {r('sum(volume)', 'volume')} FROM k GROUP BY sid, (n - 1) // 10")
def rs8_ten_tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = resample.preset(src.ticks_as_bars(event_ticks(spark, sf_dir)), "ticks", 10, tie=("tb",))
    return shown(bars, "sid", "ts", "open", "high", "low", "close", "volume")


@query("SELECT event_id, strftime(date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS days, strftime(date_trunc('week', ts) + INTERVAL 7 DAY - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS weeks, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS months, strftime(date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS years, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS hours FROM events")
def rs11_period_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table(spark, sf_dir, "events").select("event_id", *[period_end(F.col("ts"), u).alias(u) for u in ("days", "weeks", "months", "years", "hours")]))


@query(f"WITH ticks AS ({EVENTS}) SELECT f AS frame, sid, {t('e', 'ts')}, {r('arg_min(price, (ts, tb))', 'open')}, {r('max(price)', 'high')}, {r('min(price)', 'low')}, {r('arg_max(price, (ts, tb))', 'close')}, {r('sum(volume)', 'volume')} FROM (SELECT *, 'hours' AS f, {edge('ts', 3600)} AS e FROM ticks UNION ALL SELECT *, 'minutes', {edge('ts', 300)} FROM ticks) x GROUP BY f, sid, e")
def rs12_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = resample.timeframes(src.ticks_as_bars(event_ticks(spark, sf_dir)), [("hours", 1), ("minutes", 5)], tie=("tb",))
    return shown(sinks.union_all([df.select(F.lit(unit).alias("frame"), "sid", "ts", "open", "high", "low", "close", "volume") for (unit, _), df in frames.items()]))


# --- sources ----------------------------------------------------------------------


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, {t()}, {r('price', 'close')} FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND sid IN ('click', 'view')")
def src10_range_and_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.select_range(event_ticks(spark, sf_dir), "2024-01-05", "2024-01-12", ["click", "view"]).select("sid", "ts", F.col("price").alias("close")))


@query(f"{DAYS}, f AS (SELECT sid, ts, close, CASE WHEN ts < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS feed FROM bars), m AS (SELECT sid, max(ts) AS seen FROM f WHERE feed = 0 GROUP BY sid) SELECT f.sid, {t('f.ts', 'ts')}, {r('f.close', 'close')} FROM f LEFT JOIN m ON f.sid = m.sid WHERE f.feed = 0 OR m.seen IS NULL OR f.ts > m.seen")
def src8_chained_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = day_bars(spark, sf_dir).select("sid", "ts", "close")
    return shown(src.chain([bars.where("ts < timestamp '1998-01-01'"), bars.where("ts >= timestamp '1997-06-01'")]))


@query(f"WITH ticks AS ({TICKS}), k AS (SELECT *, row_number() OVER (PARTITION BY sid, ts ORDER BY tb) AS n FROM ticks) SELECT sid, {t()}, {r('price')} FROM k WHERE n = 1")
def src9_advance_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.advance_only(ticks(spark, sf_dir), arrival=("tb",)), "sid", "ts", "price")


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, {t('date_trunc(\'hour\', ts)', 'ts')}, {r('avg(price)', 'close')}, {r('avg(volume)', 'volume')} FROM ticks GROUP BY sid, date_trunc('hour', ts)")
def src11_time_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.time_mean(src.ticks_as_bars(event_ticks(spark, sf_dir)), 3600), "sid", "ts", "close", "volume")


@query(f"{DAYS}SELECT sid, {t()}, {r('high', 'ask')}, {r('low', 'bid')}, {r('(high + low) / 2', 'middle')} FROM bars")
def src12_quote_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = day_bars(spark, sf_dir).select("sid", "ts", *[F.col(c).alias(f"{p}_{s}") for p in ("open", "high", "low", "close") for s, c in (("ask", "high"), ("bid", "low"))])
    ask, bid, middle = src.quote_side(quotes, True), src.quote_side(quotes), src.quote_side(quotes, bid_ask=False)
    out = [df.select("sid", "ts", F.col("close").alias(n)) for df, n in ((ask, "ask"), (bid, "bid"), (middle, "middle"))]
    return shown(out[0].join(out[1], ["sid", "ts"]).join(out[2], ["sid", "ts"]))


@query("WITH n AS (SELECT DISTINCT l_linenumber AS n FROM lineitem WHERE l_linenumber <= 7), s AS (SELECT DISTINCT l_suppkey AS sid FROM lineitem), w AS (SELECT l_suppkey AS sid, l_linenumber AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), a AS (SELECT sid, unnest(range(1, 8)) AS n FROM s) SELECT a.sid, '1995-01-0' || (a.n + 1) AS day, nullif(coalesce(q, 0), 0) / 100.0e0 AS close FROM a LEFT JOIN w ON w.sid = a.sid AND w.n = a.n")
def src13_price_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column a day for each of the seven line numbers."""
    li = table(spark, sf_dir, "lineitem")
    wide = li.groupBy(F.col("l_suppkey").alias("sid")).agg(*[F.coalesce(F.sum(F.when(F.col("l_linenumber") == n, F.col("l_quantity"))), F.lit(0.0)).alias(f"1995010{n + 1}") for n in range(1, 8)])
    return shown(src.matrix_to_long(wide, "close", scale=100.0))


@query(f"{DAYS}SELECT sid, {d('min(ts)', 'first_day')}, {d('max(ts)', 'last_day')} FROM bars GROUP BY sid")
def src14_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.lifetimes(day_bars(spark, sf_dir).withColumn("day", F.to_date("ts"))))


_ASK = "asked AS (SELECT DISTINCT o_custkey % 100 AS sid, o_orderdate::DATE AS day FROM orders)"


@query(f"{DAYS}, {_ASK} SELECT a.sid, {d('a.day', 'day')}, {d('max(b.ts)', 'last_traded')} FROM asked a LEFT JOIN bars b ON a.sid = b.sid AND b.volume <> 0 AND b.ts <= a.day GROUP BY a.sid, a.day")
def src15_last_traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("sid"), F.to_date("o_orderdate").alias("day")).distinct()
    return shown(src.last_traded(asked, day_bars(spark, sf_dir).withColumn("day", F.to_date("ts"))))


@query(f"{DAYS}, {_ASK.replace('% 100', '% 120')}, life AS (SELECT sid, min(ts) AS a, max(ts) AS z FROM bars GROUP BY sid) SELECT q.sid, {d('q.day', 'day')}, {r('b.close', 'close')}, CASE WHEN l.a IS NULL THEN 'unknown' WHEN q.day < l.a THEN 'before_start' WHEN q.day > l.z THEN 'after_end' WHEN b.close IS NULL THEN 'no_data' ELSE 'ok' END AS status FROM asked q LEFT JOIN life l ON l.sid = q.sid LEFT JOIN bars b ON b.sid = q.sid AND b.ts = q.day")
def src16_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 120).alias("sid"), F.to_date("o_orderdate").alias("day")).distinct()
    return shown(src.lookup(asked, day_bars(spark, sf_dir).withColumn("day", F.to_date("ts")), "close"))


@query(f"{DAYS}SELECT sid, {r('close')} FROM bars WHERE ts = TIMESTAMP '1998-03-02'")
def src17_close_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.close_snapshot(day_bars(spark, sf_dir), "1998-03-02"))


_FACT = "f AS (SELECT DISTINCT s_suppkey AS sid, DATE '1997-01-01' + (s_suppkey % 700)::INT AS day, 1 + (s_suppkey % 7) / 10.0e0 AS factor FROM supplier)"


@query(f"{DAYS}, {_FACT} SELECT b.sid, {t('b.ts', 'ts')}, {r('b.close * CASE WHEN b.ts < f.day THEN f.factor ELSE 1 END', 'close')}, {r('b.volume / CASE WHEN b.ts < f.day THEN f.factor ELSE 1 END', 'volume')} FROM bars b LEFT JOIN f ON b.sid = f.sid")
def src18_forward_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    factors = s.select(F.col("s_suppkey").alias("sid"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") % 700).cast("int")).alias("day"), (1 + (F.col("s_suppkey") % 7) / 10).alias("factor")).distinct()
    bars = src.forward_adjust(day_bars(spark, sf_dir).withColumn("day", F.to_date("ts")), factors)
    return shown(bars, "sid", "ts", "close", "volume")


# --- metric tables ------------------------------------------------------------------


@query(f"{DAYS}SELECT sid, {t()}, 'close' AS metric, {r('close', 'value')} FROM bars UNION ALL SELECT sid, {t()}, 'volume', {r('volume', 'value')} FROM bars")
def snk4_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(sinks.metric_log(day_bars(spark, sf_dir), ["close", "volume"], ids=("sid", "ts")))


@query(f"{DAYS}, l AS (SELECT sid, ts, CASE WHEN volume > 20 THEN close END AS c, CASE WHEN volume <= 40 THEN volume END AS v FROM bars), f AS (SELECT sid, ts, last_value(c IGNORE NULLS) OVER {UPTO} AS close, last_value(v IGNORE NULLS) OVER {UPTO} AS volume FROM l WHERE c IS NOT NULL OR v IS NOT NULL) SELECT sid, {t()}, {r('close')}, {r('volume')} FROM f WHERE close IS NOT NULL")
def snk5_metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = day_bars(spark, sf_dir, dealt=True)
    log = sinks.metric_log(bars.select("sid", "ts", F.when(F.col("volume") > 20, F.col("close")).alias("close"), F.when(F.col("volume") <= 40, F.col("volume")).alias("volume")), ["close", "volume"], ids=("sid", "ts"))
    return shown(sinks.metric_pivot(log, ["close", "volume"], by=("sid",)))


@query("SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) + 0.0e0 AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def snk7_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    best = sinks.latest_by_key(o.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return best.select("o_custkey", "o_orderkey", "o_orderstatus", (F.round("o_totalprice", 2) + F.lit(0.0)).alias("o_totalprice"))


@query("WITH c AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01') SELECT o_orderkey, o_orderstatus FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n")
def snk6_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    current = o.where("o_orderdate < timestamp '1998-01-01'").select("o_orderkey", "o_orderstatus")
    batch = o.where("o_orderdate >= timestamp '1997-06-01'").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return sinks.upsert(current, batch, ["o_orderkey"], ["o_orderstatus"])


@query(f"SELECT o.o_orderkey AS order_id, {t('o.o_orderdate', 'created_dt')}, count(l.l_orderkey) AS n_fills, coalesce(string_agg(strftime(l_shipdate, '%Y-%m-%d') || ':' || l_quantity::BIGINT || ':' || l_extendedprice::DECIMAL(18, 2), ',' ORDER BY l_shipdate, l_quantity, l_extendedprice), '') AS fills FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY o.o_orderkey, o.o_orderdate")
def snk9_order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a year with all their fills."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    fills = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("executed_dt"), F.col("l_quantity").alias("executed_size"), F.col("l_extendedprice").alias("executed_price"))
    found = sinks.order_history(o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_dt")), fills, "1997-01-01", "1997-12-31")
    text = F.transform("fills", lambda x: F.concat_ws(":", F.date_format(x["executed_dt"], "yyyy-MM-dd"), x["executed_size"].cast("long").cast("string"), x["executed_price"].cast("decimal(18,2)").cast("string")))
    listed = F.coalesce(F.array_join(text, ","), F.lit(""))
    return shown(found.select("order_id", "created_dt", F.greatest(F.coalesce(F.size("fills"), F.lit(0)), F.lit(0)).cast("long").alias("n_fills"), listed.alias("fills")))


# --- filters and fillers ----------------------------------------------------------------


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, {t()}, {r('price')} FROM ticks WHERE strftime(ts, '%H:%M:%S') >= '09:30:00' AND (strftime(ts, '%H:%M:%S') < '16:00:00' OR ts = date_trunc('day', ts) + INTERVAL 16 HOUR)")
def fl1_session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fill.session_filter(event_ticks(spark, sf_dir), "09:30:00", "16:00:00"), "sid", "ts", "price")


@query(f"{DAYS}SELECT sid, {t()}, {r('close')} FROM bars WHERE close > 2000 AND volume > 10")
def fl2_predicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def above(close: pd.Series) -> pd.Series:
        return close > 2000

    bars = fill.apply_filters(day_bars(spark, sf_dir), [lambda df: fill.where_true(df, F.col("volume") > 10), lambda df: fill.where_true(df, above, ["close"])])
    return shown(bars, "sid", "ts", "close")


_GRID = (
    f"{HOURS}, inside AS (SELECT * FROM bars WHERE strftime(ts, '%H:%M:%S') BETWEEN '09:00:00' AND '17:00:00'), days AS (SELECT sid, ts::DATE AS day, min(ts) AS a, max(ts) AS z FROM inside GROUP BY sid, ts::DATE), ends AS (SELECT *, min(day) OVER (PARTITION BY sid) AS d0, max(day) OVER (PARTITION BY sid) AS d1 FROM days), "
    "slots AS (SELECT sid, day + INTERVAL 9 HOUR + i * INTERVAL 1 HOUR AS ts, a, z, day, d0, d1 FROM ends, (SELECT unnest(range(0, 9)) AS i) g), "
    "grid AS (SELECT sid, ts FROM slots WHERE (day > d0 OR ts >= a) AND (day < d1 OR ts <= z)), "
    f"full_ AS (SELECT g.sid, g.ts, b.close, b.volume, b.close IS NULL AS is_filled FROM grid g LEFT JOIN inside b ON g.sid = b.sid AND g.ts = b.ts) SELECT sid, {t()}, {r(f'last_value(close IGNORE NULLS) OVER {UPTO}', 'close')}, {r('volume')}, is_filled FROM full_"
)


@query(_GRID)
def fl3_session_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = fill.session_filter(hour_bars(spark, sf_dir), "09:00:00", "17:00:00")
    return shown(fill.session_fill(inside, 3600, "09:00:00", "17:00:00"), "sid", "ts", "close", "volume", "is_filled")


_CAL = f"{DAYS}, n AS (SELECT *, lead(ts) OVER (PARTITION BY sid ORDER BY ts) AS nx FROM bars), f AS (SELECT sid, ts, close, volume, FALSE AS is_filled FROM bars UNION ALL SELECT sid, unnest(generate_series(ts + INTERVAL 1 DAY, nx - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS ts, close, NULL, TRUE FROM n WHERE nx > ts + INTERVAL 1 DAY) "


@query(f"{_CAL} SELECT sid, {t()}, {r('close')}, {r('volume')}, is_filled FROM f")
def fl5_calendar_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fill.calendar_fill(day_bars(spark, sf_dir)), "sid", "ts", "close", "volume", "is_filled")


@query(f"{_CAL} SELECT sid, {t()}, {r('close')}, is_filled FROM f WHERE NOT is_filled OR isodow(ts) < 6")
def fl6_weekday_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fill.weekday_fill(day_bars(spark, sf_dir), fill_close=True), "sid", "ts", "close", "is_filled")


@query(f"{DAYS}SELECT sid, 0::BIGINT AS part, {t('ts + INTERVAL 9 HOUR', 'ts')}, {r('(open + high + low) / 3', 'close')}, {r('floor(volume / 2)', 'volume')} FROM bars UNION ALL SELECT sid, 1, {t('ts + INTERVAL 1050 MINUTE', 'ts')}, {r('close')}, {r('volume - floor(volume / 2)', 'volume')} FROM bars")
def fl7_split_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fill.split_day(day_bars(spark, sf_dir)), "sid", "part", "ts", "close", "volume")


@query(f"{DAYS}SELECT sid, 0::BIGINT AS part, {t()}, {r('open', 'close')}, 0.0e0 AS volume FROM bars UNION ALL SELECT sid, 1, {t()}, {r('close')}, {r('volume')} FROM bars")
def fl8_open_then_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fill.open_then_full(day_bars(spark, sf_dir)), "sid", "part", "ts", "close", "volume")


@query(f"{DAYS}SELECT sid, 0::BIGINT AS part, {t('ts + INTERVAL 9 HOUR', 'ts')}, {r('open', 'close')}, {r('floor(volume / 2)', 'volume')} FROM bars UNION ALL SELECT sid, 1, {t('ts + INTERVAL 1050 MINUTE', 'ts')}, {r('close')}, {r('volume')} FROM bars")
def fl9_ohl_then_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fill.ohl_then_close(day_bars(spark, sf_dir)), "sid", "part", "ts", "close", "volume")


_BRICKS = f"{DAYS}, n AS (SELECT sid, ts, close, round(arg_min(open, ts) OVER (PARTITION BY sid ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS s, row_number() OVER (PARTITION BY sid ORDER BY ts) AS i FROM bars), k AS (SELECT sid, ts, i, s, NULL::INT AS was, CASE WHEN close >= s + 500 THEN 1 WHEN close <= s - 500 THEN -2 END AS k FROM n WHERE i = 1 UNION ALL SELECT n.sid, n.ts, n.i, n.s, k.k, CASE WHEN k.k IS NULL THEN CASE WHEN n.close >= n.s + 500 THEN 1 WHEN n.close <= n.s - 500 THEN -2 END WHEN n.close >= n.s + (k.k + 1) * 500 THEN k.k + 1 WHEN n.close <= n.s + k.k * 500 THEN k.k - 1 ELSE k.k END FROM k JOIN n ON n.sid = k.sid AND n.i = k.i + 1), b AS (SELECT sid, ts, k > coalesce(was, 0) AS up, s + k * 500 AS low, s + (k + 1) * 500 AS high FROM k WHERE k IS DISTINCT FROM was)"


@query(f"{_BRICKS} SELECT sid, {t()}, {r('CASE WHEN up THEN low ELSE high END', 'open')}, {r('high')}, {r('low')}, {r('CASE WHEN up THEN high ELSE low END', 'close')}, 0.0e0 AS volume FROM b")
def fl11_renko(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fill.renko(day_bars(spark, sf_dir), tie=(), size=500.0))


# --- alignment ----------------------------------------------------------------------------

_SLOW = f"{DAYS}, slow AS (SELECT sid, max(ts) AS ts, arg_max(close, ts) AS slow_close FROM bars GROUP BY sid, date_trunc('month', ts))"


def _slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_bars(spark, sf_dir).select("sid", "ts", F.col("close").alias("slow_close"))


@query(f"{_SLOW} SELECT b.sid, {t('b.ts', 'ts')}, {r('arg_max(s.slow_close, s.ts)', 'slow_close')} FROM bars b LEFT JOIN slow s ON s.sid = b.sid AND s.ts <= b.ts GROUP BY b.sid, b.ts")
def jn1_couple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(align.couple(day_bars(spark, sf_dir), _slow(spark, sf_dir), ["slow_close"]), "sid", "ts", "slow_close")


@query(f"{_SLOW} SELECT b.sid, {t('b.ts', 'ts')}, {r('arg_max(s.slow_close, s.ts)', 'slow_close')} FROM bars b LEFT JOIN slow s ON s.sid = b.sid AND s.ts < b.ts GROUP BY b.sid, b.ts")
def jn2_couple_no_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(align.couple(day_bars(spark, sf_dir), _slow(spark, sf_dir), ["slow_close"], look_ahead=False), "sid", "ts", "slow_close")


_KINDS = ("click", "error", "purchase", "signup", "view")
_CLOCK = ", ".join(f"max(CASE WHEN sid = '{k}' THEN close END) AS {k}_" for k in _KINDS)


@query(f"{HOURS}, k AS (SELECT ts, {_CLOCK} FROM bars GROUP BY ts) SELECT {t()}, {', '.join(r(f'last_value({k}_ IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)', f'{k}_') for k in _KINDS)} FROM k")
def jn3_shared_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event types on one clock."""
    bars = hour_bars(spark, sf_dir)
    return shown(align.shared_clock({f"{k}_": bars.where(F.col("sid") == k) for k in _KINDS}))


@query(f"{HOURS} SELECT {t('a.ts', 'ts')}, a.sid AS sid_l, b.sid AS sid_r, {r('a.close', 'close_l')}, {r('b.close', 'close_r')} FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.sid < b.sid")
def jn4_equal_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which two event types have bars, for all pairs of the five types."""
    bars = hour_bars(spark, sf_dir).select("sid", "ts", "close")
    return shown(align.equal_times(bars, bars).where("sid_l < sid_r"), "ts", "sid_l", "sid_r", "close_l", "close_r")


_BM = "bm AS (SELECT date_trunc('week', ts)::DATE AS day, avg(close) AS ret FROM bars GROUP BY date_trunc('week', ts)::DATE)"


@query(f"{DAYS}, {_BM}, q AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT {d('q.day', 'day')}, {d('min(bm.day)', 'benchmark_day')}, {r('arg_min(bm.ret, bm.day)', 'ret')} FROM q LEFT JOIN bm ON bm.day >= q.day GROUP BY q.day")
def jn5_benchmark_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    bm = day_bars(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("day")).agg(F.avg("close").alias("ret"))
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return shown(align.benchmark_on(days, bm))


@query("SELECT l.l_orderkey AS order_id, l.l_linenumber::BIGINT AS line, o.o_custkey AS sid FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def jn6_fills_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"))
    return align.fills_with_orders(fills, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("sid")))


_OT = "o AS (SELECT event_id AS order_id, event_type AS sid, ts AS created_dt FROM events)"


@query(f"{HOURS}, {_OT} SELECT o.order_id, o.sid, {t('min(b.ts)', 'bar_ts')} FROM o LEFT JOIN bars b ON b.sid = o.sid AND b.ts >= o.created_dt AND b.ts::DATE = o.created_dt::DATE GROUP BY o.order_id, o.sid")
def jn7_first_bar_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    orders = e.select(F.col("event_id").alias("order_id"), F.col("event_type").alias("sid"), F.col("ts").alias("created_dt"))
    return shown(align.first_bar_after(orders, hour_bars(spark, sf_dir)), "order_id", "sid", "bar_ts")


@query("SELECT c.c_custkey AS sid, coalesce(CASE WHEN s.s_nationkey % 2 = 0 THEN s.s_name END, '0') AS merger, round(coalesce(CASE WHEN s.s_nationkey % 3 = 0 THEN s.s_acctbal END, 0), 2) + 0.0e0 AS ratio FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def jn8_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    dim = s.select(F.col("s_suppkey").alias("sid"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).alias("merger"), F.when(F.col("s_nationkey") % 3 == 0, F.col("s_acctbal")).alias("ratio"))
    out = align.enrich(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid")), dim)
    return out.select("sid", "merger", (F.round("ratio", 2) + F.lit(0.0)).alias("ratio"))


@query("WITH y AS (SELECT DISTINCT l_suppkey AS sid, l_partkey AS part FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), tr AS (SELECT DISTINCT l_suppkey AS sid, l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT DISTINCT l_suppkey AS sid, l_partkey AS part FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01') SELECT * FROM (SELECT * FROM y UNION SELECT * FROM tr) EXCEPT SELECT * FROM h")
def jn9_closed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sid"), F.col("l_partkey").alias("part"), "l_shipdate", "l_returnflag")
    yesterday, traded, held = li.where("l_shipdate < timestamp '1996-01-01'"), li.where("l_returnflag = 'R'"), li.where("l_shipdate >= timestamp '2001-01-01'")
    return align.closed_series(yesterday, traded, held.distinct(), ("sid", "part"))


# --- calendars -------------------------------------------------------------------------------

_DAYS = "WITH days AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE isodow(l_shipdate) < 6)"


def _trading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).where(F.weekday("l_shipdate") < 5).distinct()


@query(f"{_DAYS} SELECT {d('day')}, {d('lead(day) OVER (ORDER BY day)', 'next_day')}, {t('day + INTERVAL 570 MINUTE', 'open_ts')}, {t('day + INTERVAL 900 MINUTE', 'close_ts')} FROM days")
def cal2_next_day_and_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _trading(spark, sf_dir)
    return shown(calendar.next_trading_day(days).join(calendar.sessions(days, "09:30:00", "15:00:00"), "day"))


@query("WITH b AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders), g AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM b), o AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) SELECT strftime(g.day, '%Y-%m-%d') AS day, coalesce(o.n, 0) AS n FROM g LEFT JOIN o ON g.day = o.day WHERE isodow(g.day) < 6 AND strftime(g.day, '%m-%d') <> '12-25'")
def cal1_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, z = (str(x) for x in o.agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first())
    days = calendar.allowed(calendar.trading_days(spark, a, z), F.date_format("day", "MM-dd") != "12-25")
    counts = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return shown(days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n")))


@query(f"{_DAYS}, n AS (SELECT day, lead(day) OVER (ORDER BY day) AS nx FROM days) SELECT {d('day')}, coalesce(date_trunc('week', nx) <> date_trunc('week', day), TRUE) AS last_of_week, coalesce(date_trunc('month', nx) <> date_trunc('month', day), TRUE) AS last_of_month, coalesce(date_trunc('year', nx) <> date_trunc('year', day), TRUE) AS last_of_year, weekofyear(nx)::BIGINT AS next_week FROM n")
def cal4_period_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calendar.period_closes(_trading(spark, sf_dir)))


@query(f"WITH ticks AS ({EVENTS}), g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS n FROM ticks WINDOW w AS (PARTITION BY sid ORDER BY ts, tb)) SELECT sid, tb, sum(n) OVER (PARTITION BY sid ORDER BY ts, tb ROWS UNBOUNDED PRECEDING)::BIGINT AS session_id FROM g")
def cal6_session_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.session_breaks(event_ticks(spark, sf_dir), 1.0, tie=("tb",)).select("sid", "tb", "session_id")


@query(f"WITH ticks AS ({EVENTS}), k AS (SELECT *, floor((epoch_us(ts) - epoch_us(date_trunc('day', ts)) - 34200000000) / 3600000000.0e0) AS slot FROM ticks WHERE epoch_us(ts) - epoch_us(date_trunc('day', ts)) BETWEEN 34200000000 AND 57600000000) SELECT sid, tb, {t()} FROM k QUALIFY row_number() OVER (PARTITION BY sid, ts::DATE, slot ORDER BY ts, tb) = 1")
def cal7_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calendar.schedule(event_ticks(spark, sf_dir), "09:00:00", offset=1800, repeat=3600, until="16:00:00", tie=("tb",)), "sid", "tb", "ts")


@query(f"{_DAYS}, b AS (SELECT unnest(generate_series((SELECT min(day) FROM days), (SELECT max(day) FROM days), INTERVAL 1 DAY))::DATE AS target) SELECT {d('b.target', 'target')}, {d('min(days.day)', 'day')} FROM b JOIN days ON days.day >= b.target WHERE day(b.target) IN (1, 15) GROUP BY b.target")
def cal8_month_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calendar.restricted_days(_trading(spark, sf_dir), month_days=(1, 15)))


@query(f"{_DAYS}, b AS (SELECT unnest(generate_series((SELECT min(day) FROM days), (SELECT max(day) FROM days), INTERVAL 1 DAY))::DATE AS target) SELECT {d('b.target', 'target')}, {d('min(days.day)', 'day')} FROM b JOIN days ON days.day >= b.target WHERE isodow(b.target) IN (1, 5) GROUP BY b.target")
def cal8_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mondays and Fridays, on the next trading day where they are none."""
    return shown(calendar.restricted_days(_trading(spark, sf_dir), weekdays=(1, 5)))


@query(f"{_DAYS} SELECT {d('day', 'target')}, {d('day')} FROM days WHERE isodow(day) = 3 OR day(day) = 15")
def cal8_without_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wednesdays and the 15th where they are trading days."""
    return shown(calendar.restricted_days(_trading(spark, sf_dir), weekdays=(3,), month_days=(15,), carry=False))
