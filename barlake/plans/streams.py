"""Queries that run a stream over the event table to its end and read what it wrote."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import steps
from ..operators.fill import renko
from ..operators.signals import trailing_stop_positions
from ..operators.stepwise import stepwise
from ..sources.bars import ticks_as_bars
from ..sources.workdir import new_folder
from ..streaming import live
from .base import EVENTS, HOURS, OHLC, TICKS, event_ticks, hour_bars, query, r, shown, t, ticks


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a pattern, so that a table of one file can be a source too
    e = live.stream_ticks(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema)
    return e.select(F.col("event_type").alias("sid"), "ts", F.col("event_id").alias("tb"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("value").alias("amount"))


def _run(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Everything the stream gives, with its state written to the shared folder."""
    out = new_folder(spark, f"{name}-out")
    live.metric_stream(rows, out, new_folder(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query(f"{HOURS}SELECT sid, {t()}, {OHLC} FROM bars WHERE ts <= (SELECT max(ts) FROM bars) - INTERVAL 1 HOUR")
def st2_live_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour bars that the watermark has closed."""
    return shown(_run(spark, live.live_bars(ticks_as_bars(_stream(spark, sf_dir)), "hours", tie=("tb",)), "bars"))


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, {t()}, tb FROM ticks")
def st4_drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream and a second copy of it, without the copies."""
    once = _stream(spark, sf_dir)
    with _rocks(spark):
        # events of one type and time are different events
        return shown(_run(spark, live.drop_duplicates(once.union(_stream(spark, sf_dir)), "40 days", ("sid", "ts", "tb")), "distinct"), "sid", "ts", "tb")


@query(f"WITH ticks AS ({EVENTS}), g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS n FROM ticks WINDOW w AS (PARTITION BY sid ORDER BY ts, tb)), k AS (SELECT *, sum(n) OVER (PARTITION BY sid ORDER BY ts, tb ROWS UNBOUNDED PRECEDING) AS k FROM g), z AS (SELECT sid, k, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM k GROUP BY sid, k) SELECT sid, n, {t('first_ts')}, {t('last_ts')} FROM z WHERE last_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR")
def st6_inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that an hour without events of their type has ended."""
    return shown(_run(spark, live.inactivity_sessions(_stream(spark, sf_dir), "1 hour"), "sessions"), "sid", "n", "first_ts", "last_ts")


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, {t('ts::DATE + INTERVAL 1 DAY', 'eod_ts')}, count(*) AS n, {t('max(ts)', 'last_ts')} FROM ticks GROUP BY sid, ts::DATE HAVING ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts)::DATE + INTERVAL 1 DAY - INTERVAL 1 HOUR FROM ticks)")
def st8_day_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-of-day rows of finished days."""
    return shown(_run(spark, live.day_triggers(_stream(spark, sf_dir)), "days"))


@query(f"{HOURS}SELECT sid, {t()}, {r('close', 'price')} FROM bars")
def st9_metric_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar table written and read again by a stream."""
    source = new_folder(spark, "bars-in")
    bars = hour_bars(spark, sf_dir).select("sid", "ts", F.col("close").alias("price"))
    bars.write.parquet(source)
    return shown(_run(spark, live.stream_ticks(spark, source, bars.schema), "metrics"))


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that streams with state of their own need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


_TIE = "(PARTITION BY sid ORDER BY ts, tb)"
_NUMBERED = f"WITH RECURSIVE ticks AS ({EVENTS}), n AS (SELECT sid, ts, tb, price AS close, row_number() OVER {_TIE} AS i FROM ticks)"
_OUT = "(SELECT max(ts) FROM n) - INTERVAL 1 HOUR"
_AVERAGE = f"{_NUMBERED}, s AS (SELECT sid, 14 AS i, avg(close) AS y FROM n WHERE i <= 14 GROUP BY sid), a AS (SELECT sid, i, y FROM s UNION ALL SELECT b.sid, b.i, a.y * (13.0e0 / 15) + (2.0e0 / 15) * b.close FROM a JOIN n b ON b.sid = a.sid AND b.i = a.i + 1) SELECT n.sid, {t('n.ts', 'ts')}, {r('n.close', 'close')}, {r('a.y', 'average')} FROM n LEFT JOIN a ON a.sid = n.sid AND a.i = n.i WHERE n.ts < {_OUT}"


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).withColumnRenamed("price", "close")


@query(_AVERAGE)
def st7_live_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential averages of event values, from state kept by series."""
    with _rocks(spark):
        return shown(_run(spark, live.live_average(_closes(spark, sf_dir), tie=("tb",)), "average"))


@query(_AVERAGE)
def st5_seeded_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History as a table, then a stream over all events whose averages go on from the state in which history ended."""
    history = event_ticks(spark, sf_dir).withColumnRenamed("price", "close").where("ts < timestamp '2024-01-10'")
    before = stepwise(history, steps.Average, by=("sid",), ts="ts", tie=("tb",)).select("sid", "ts", "close", "average")
    with _rocks(spark):
        after = _run(spark, live.live_average(_closes(spark, sf_dir), tie=("tb",), history=history), "seeded")
    return shown(before.unionByName(after))


_KAMA = f"{_NUMBERED}, mv AS (SELECT *, abs(close - lag(close) OVER {_TIE}) AS mv FROM n), er AS (SELECT *, abs(close - lag(close, 10) OVER {_TIE}) AS num, sum(mv) OVER (PARTITION BY sid ORDER BY ts, tb ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS den FROM mv), sc AS (SELECT *, pow(CASE WHEN abs(den) < 1e-8 THEN 0.0e0 ELSE num / den END * (2.0e0 / 3 - 2.0e0 / 31) + 2.0e0 / 31, 2) AS sc FROM er), k AS (SELECT sid, 10 AS i, avg(close) AS y FROM n WHERE i <= 10 GROUP BY sid HAVING count(*) = 10 UNION ALL SELECT b.sid, b.i, (1 - b.sc) * k.y + b.sc * b.close FROM k JOIN sc b ON b.sid = k.sid AND b.i = k.i + 1)"


@query(f"{_KAMA} SELECT n.sid, {t('n.ts', 'ts')}, n.tb, {r('n.close', 'close')}, {r('k.y', 'kama')} FROM n LEFT JOIN k ON k.sid = n.sid AND k.i = n.i WHERE n.ts < {_OUT}")
def st7_live_kama(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kaufman averages of event values: the last ten of a series are its state."""
    with _rocks(spark):
        return shown(_run(spark, live.live_kama(_closes(spark, sf_dir), 10, tie=("tb",)), "kama"))


def _bricks(n: str, size: int) -> str:
    """Bricks of the rows n (sid, ts, tb, close, i): how far each series' band stands from its first value, in bricks."""
    return f"{n}, o AS (SELECT sid, round(arg_min(close, i)) AS s FROM n GROUP BY sid), k AS (SELECT n.sid, n.ts, n.tb, n.i, o.s, NULL::INT AS was, CASE WHEN close >= s + {size} THEN 1 WHEN close <= s - {size} THEN -2 END AS k FROM n JOIN o ON o.sid = n.sid WHERE i = 1 UNION ALL SELECT n.sid, n.ts, n.tb, n.i, k.s, k.k, CASE WHEN k.k IS NULL THEN CASE WHEN n.close >= k.s + {size} THEN 1 WHEN n.close <= k.s - {size} THEN -2 END WHEN n.close >= k.s + (k.k + 1) * {size} THEN k.k + 1 WHEN n.close <= k.s + k.k * {size} THEN k.k - 1 ELSE k.k END FROM k JOIN n ON n.sid = k.sid AND n.i = k.i + 1), b AS (SELECT sid, ts, tb, k > coalesce(was, 0) AS up, s + k * {size} AS low, s + (k + 1) * {size} AS high FROM k WHERE k IS DISTINCT FROM was) SELECT sid, {t()}, tb, {r('CASE WHEN up THEN low ELSE high END', 'open')}, {r('high')}, {r('low')}, {r('CASE WHEN up THEN high ELSE low END', 'close')} FROM b"


def _as_bars(ticks: DataFrame) -> DataFrame:
    return ticks.select("sid", "ts", "tb", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")])


_SHOWN = ("sid", "ts", "tb", "open", "high", "low", "close")


@query(f"{_bricks(_NUMBERED, 10)} WHERE ts < {_OUT}")
def st7_live_renko(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks of event values as they are drawn."""
    with _rocks(spark):
        return shown(_run(spark, live.live_renko(_as_bars(_stream(spark, sf_dir)), 10.0, tie=("tb",)), "renko"), *_SHOWN)


_DAY_TICKS = f"WITH RECURSIVE ticks AS ({TICKS}), n AS (SELECT sid, ts, tb, price AS close, row_number() OVER {_TIE} AS i FROM ticks)"


@query(_bricks(_DAY_TICKS, 500))
def fl11_renko_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks of line items, many of one series and day: the tie-break decides."""
    return shown(renko(_as_bars(ticks(spark, sf_dir)), tie=("tb",), size=500.0), *_SHOWN)


@query(f"{_DAY_TICKS}, st AS (SELECT n.*, CASE WHEN tb % 5 = 0 THEN close - 300 END AS stop FROM n WHERE i = 1 UNION ALL SELECT n.*, CASE WHEN st.stop IS NULL THEN CASE WHEN n.tb % 5 = 0 THEN n.close - 300 END WHEN n.close >= st.stop THEN greatest(st.stop, n.close - 300) END FROM st JOIN n ON n.sid = st.sid AND n.i = st.i + 1) SELECT sid, {t()}, tb, (stop IS NOT NULL)::BIGINT AS position, {r('stop')} FROM st")
def sg8_trailing_stop_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-arming stops on line items, many of one series and day: the tie-break decides."""
    rows = ticks(spark, sf_dir).select("sid", "ts", "tb", F.col("price").alias("close"), (F.col("tb") % 5 == 0).alias("go"), F.lit(300.0).alias("gap"))
    return shown(trailing_stop_positions(rows, "go", "gap", tie=("tb",)))


@query(f"WITH ticks AS ({EVENTS}), k AS (SELECT sid, time_bucket(INTERVAL 1 HOUR, ts) AS h, count(*) AS n, max(ts) AS z FROM ticks GROUP BY ALL), g AS (SELECT sid, unnest(generate_series(min(h), (SELECT max(ts) FROM ticks) - INTERVAL 2 HOUR, INTERVAL 1 HOUR)) AS h FROM k GROUP BY sid) SELECT g.sid, {t('g.h + INTERVAL 1 HOUR', 'trigger_ts')}, coalesce(k.n, 0) AS n, {t('max(k.z) OVER (PARTITION BY g.sid ORDER BY g.h ROWS UNBOUNDED PRECEDING)', 'last_ts')} FROM g LEFT JOIN k ON k.sid = g.sid AND k.h = g.h")
def st8_clock_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A risk row a series and hour by the clock, also for hours without events."""
    with _rocks(spark):
        return shown(_run(spark, live.clock_triggers(_stream(spark, sf_dir), 3600), "clock"))


#: When an event reaches the stream: up to 99 hours after its time.
_ARRIVAL = "ts + make_interval(0, 0, 0, 0, tb * 7919 % 100, 0, 0)"
_CUTS = ("2024-01-08", "2024-01-17", "2024-01-25", "2100-01-01")


@query(f"WITH ticks AS ({EVENTS}), a AS (SELECT *, ts + to_hours(tb * 7919 % 100) AS arrival FROM ticks) SELECT sid, {t()}, tb, coalesce(ts < max(ts) OVER (PARTITION BY sid ORDER BY arrival, tb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM a")
def st3_late_side_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as they arrive, in four micro-batches: rows on time go to one table, late ones to another beside it.

    The stream is stopped after each micro-batch and goes on from its checkpoint.
    """
    rows = event_ticks(spark, sf_dir).select("sid", "ts", "tb").withColumn("arrival", F.expr(_ARRIVAL))
    source, out, side, state = (new_folder(spark, name) for name in ("arrivals", "on-time", "late", "late-state"))
    before = "1900-01-01"
    with _rocks(spark):
        for cut in _CUTS:
            rows.where((F.col("arrival") >= F.lit(before).cast("timestamp")) & (F.col("arrival") < F.lit(cut).cast("timestamp"))).write.mode("append").parquet(source)
            live.split_late(live.stream_ticks(spark, source, rows.schema), out, side, state, arrival=("arrival", "tb")).awaitTermination()
            before = cut
    on_time, late = (spark.read.schema(rows.schema).parquet(p) for p in (out, side))
    return shown(on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))), "sid", "ts", "tb", "late")


_SEEN_DAY = "2024-01-10"


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, {t()}, tb, {r('price')} FROM ticks")
def st5_hand_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History as a batch, then a stream over all events that goes on where each series' history ended."""
    stream = _stream(spark, sf_dir).select("sid", "ts", "tb", "price")
    history = event_ticks(spark, sf_dir).select(*stream.columns).where(F.col("ts") < F.lit(_SEEN_DAY).cast("timestamp"))
    out = new_folder(spark, "hand-over")
    with _rocks(spark):
        live.hand_over(history, stream, out, new_folder(spark, "hand-over-state")).awaitTermination()
    return shown(spark.read.schema(stream.schema).parquet(out), "sid", "ts", "tb", "price")
