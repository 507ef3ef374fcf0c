"""Further queries: slot volumes, gap filling, sessions, latest rows, exports, late and backfilled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocate, calendar, fill, performance, rolling
from ..operators.recursive import atr
from ..sources import bars as src
from ..sources import sinks
from ..sources.workdir import new_folder
from ..streaming import live
from .base import DAYS, HOURS, MONTHS, UPTO, day_bars, hour_bars, month_bars, query, r, shown, t, table
from .indicators import ATR


@query(f"{HOURS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY sid ORDER BY ts::DATE) AS rk, row_number() OVER w AS n, lag(volume) OVER w AS pv FROM bars WINDOW w AS (PARTITION BY sid, strftime(ts, '%H:%M:%S') ORDER BY ts::DATE, ts)) SELECT sid, {t()}, {r('CASE WHEN n = rk THEN volume / pv END', 'relative_volume')} FROM k")
def wn20_relative_volume_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rolling.relative_volume_by_slot(hour_bars(spark, sf_dir)), "sid", "ts", "relative_volume")


@query(
    f"{HOURS}, inside AS (SELECT * FROM bars WHERE strftime(ts, '%H:%M:%S') BETWEEN '09:00:00' AND '17:00:00'), days AS (SELECT sid, ts::DATE AS day, max(ts) AS z FROM inside GROUP BY sid, ts::DATE), ends AS (SELECT *, max(day) OVER (PARTITION BY sid) AS d1 FROM days), "
    "slots AS (SELECT sid, day + INTERVAL 9 HOUR + i * INTERVAL 1 HOUR AS ts, z, day, d1 FROM ends, (SELECT unnest(range(0, 8)) AS i) g), grid AS (SELECT sid, ts FROM slots WHERE day < d1 OR ts <= z UNION SELECT sid, ts FROM inside), "
    f"full_ AS (SELECT g.sid, g.ts, b.close, b.close IS NULL AS is_filled FROM grid g LEFT JOIN inside b ON g.sid = b.sid AND g.ts = b.ts) SELECT sid, {t()}, {r(f'last_value(close IGNORE NULLS) OVER {UPTO}', 'close')}, is_filled FROM full_"
)
def fl4_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = fill.session_filter(hour_bars(spark, sf_dir), "09:00:00", "17:00:00")
    return shown(fill.gap_fill(inside, 3600, "09:00:00", "17:00:00"), "sid", "ts", "close", "is_filled")


@query("WITH days AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE isodow(l_shipdate) < 6), s AS (SELECT day, day + CASE WHEN isodow(day) = 5 THEN INTERVAL 12 HOUR ELSE INTERVAL 15 HOUR END AS close_ts FROM days), e AS (SELECT event_id, ts - INTERVAL 9490 DAY AS ts FROM events) SELECT e.event_id, strftime(arg_min(s.day, s.close_ts), '%Y-%m-%d') AS day FROM e LEFT JOIN s ON s.close_ts >= e.ts GROUP BY e.event_id")
def cal3_session_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).where(F.weekday("l_shipdate") < 5).distinct()
    early = days.where(F.weekday("day") == 4).select("day", F.lit("09:30:00").alias("open_time"), F.lit("12:00:00").alias("close_time"))
    rows = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(F.unix_micros("ts") - 9490 * 86_400_000_000).alias("ts"))
    return shown(calendar.session_of(rows, calendar.sessions(days, "09:30:00", "15:00:00", early)), "event_id", "day")


@query("SELECT o_custkey % 50 AS experiment_id, o_custkey AS sid, o_orderdate::DATE::VARCHAR AS day, o_orderkey AS size FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def snk8_latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pos = o.select((F.col("o_custkey") % 50).alias("experiment_id"), F.col("o_custkey").alias("sid"), F.col("o_orderdate").alias("datetime"), F.col("o_orderkey").alias("size"))
    return sinks.latest_positions(pos).select("experiment_id", "sid", F.to_date("datetime").cast("string").alias("day"), "size")


@query(f"{MONTHS} SELECT sid AS experiment_id, {t('ts', 'day')}, m AS metric, {r('v', 'value')} FROM (SELECT sid, ts, 'portfolio_value' AS m, close AS v FROM bars UNION ALL SELECT sid, ts, 'cash', amount FROM bars UNION ALL SELECT sid, ts, 'pnl', close - open FROM bars) x")
def pf11_portfolio_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = month_bars(spark, sf_dir).select(F.col("sid").alias("experiment_id"), F.col("ts").alias("day"), F.col("close").alias("portfolio_value"), F.col("amount").alias("cash"), (F.col("close") - F.col("open")).alias("pnl"))
    return shown(performance.portfolio_export(rows))


@query(f"{ATR} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('0.01e0 * nb.close / atr.y', 'weight')} FROM nb LEFT JOIN atr ON nb.sid = atr.sid AND nb.rn = atr.rn")
def al4_volatility_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each month's bars by their volatility."""
    return shown(allocate.volatility_weight(atr(month_bars(spark, sf_dir)), 1.0, 0.01), "sid", "ts", "weight")


_HALF = f"{DAYS}, h AS (SELECT sid, max(ts) AS z FROM bars WHERE ts < TIMESTAMP '1999-01-01' GROUP BY sid)"


@query(f"{_HALF} SELECT b.sid, {t('b.ts', 'ts')}, {r('b.close', 'close')} FROM bars b JOIN h ON h.sid = b.sid")
def st5_backfill_then_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History to a day, and of overlapping later rows those after its end."""
    bars = day_bars(spark, sf_dir).select("sid", "ts", "close")
    return shown(live.backfill_then_live(bars.where("ts < timestamp '1999-01-01'"), bars.where("ts >= timestamp '1998-01-01'")))


@query(f"{_HALF} SELECT b.sid, {t('b.ts', 'ts')}, b.ts < h.z AS late FROM bars b JOIN h ON h.sid = b.sid WHERE b.ts >= TIMESTAMP '1998-01-01'")
def st3_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = day_bars(spark, sf_dir).select("sid", "ts")
    last = bars.where("ts < timestamp '1999-01-01'").groupBy("sid").agg(F.max("ts").alias("last_ts"))
    on_time, late = live.late_rows(bars.where("ts >= timestamp '1998-01-01'"), last)
    return shown(on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))))


@query(f"{DAYS} SELECT sid, {t('ts + INTERVAL 15 HOUR', 'ts')}, {r('open')}, {r('close')} FROM bars")
def src3_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as text by series and read by position, times raised to the session's end."""
    path = new_folder(spark, "csv")
    bars = day_bars(spark, sf_dir)
    sinks.write_csv(bars.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume", "sid"), path)
    read = src.read_csv(spark, path, date_format="yyyy-MM-dd", session_end="15:00:00")
    return shown(read.select(F.col("openinterest").cast("long").alias("sid"), "ts", "open", "close"))


@query(f"{DAYS}SELECT sid, {t()}, {r('close')}, {r('volume')} FROM bars")
def src1_parquet_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as Parquet and some of their columns read again."""
    path = new_folder(spark, "bars")
    sinks.write_parquet(day_bars(spark, sf_dir), path)
    return shown(src.read_bars(spark, path, ("sid", "ts", "close", "volume")))


@query("WITH w AS (SELECT l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS k, l_quantity FROM lineitem) SELECT l_suppkey AS sid, sum(l_quantity)::BIGINT AS last_ten FROM w WHERE k <= 10 GROUP BY l_suppkey")
def ex8_last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the last ten volumes at each series' end."""
    from ..functions.exprs import last_values
    from .base import ticks

    order = ("ts", "tb")
    rows = ticks(spark, sf_dir).withColumn("v", last_values(F.col("volume"), 10, order=order))
    return rows.groupBy("sid").agg(F.max_by("v", F.struct(*order)).alias("v")).select("sid", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("long").alias("last_ten"))
