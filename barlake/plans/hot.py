"""Queries over few series with very many rows: each series is cut into stretches and spread over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recursive, rolling, stretches
from ..operators.fill import renko
from ..operators.signals import trailing_stop_positions
from .base import EVENTS, TICKS, event_ticks, query, r, shown, t, ticks
from .streams import _NUMBERED, _SHOWN, _as_bars, _bricks

_HOT = f"WITH ticks AS ({TICKS}), hot AS (SELECT sid % 2 AS sid, ts, tb, price, volume FROM ticks)"
_BACK = "(PARTITION BY sid ORDER BY ts, tb ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_UPTO = "(PARTITION BY sid ORDER BY ts, tb ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_KEY = {"by": ("sid",), "order": ("ts", "tb")}
MONTH = 30 * 86_400


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as two series."""
    return ticks(spark, sf_dir).select((F.col("sid") % 2).alias("sid"), "ts", "tb", F.col("price").alias("close"), "volume")


@query(f"{_HOT} SELECT sid, {t()}, tb, CASE WHEN row_number() OVER (PARTITION BY sid ORDER BY ts, tb) >= 20 THEN {r(f'avg(price) OVER {_BACK}', 'sma').rpartition(' AS ')[0]} END AS sma, CASE WHEN row_number() OVER (PARTITION BY sid ORDER BY ts, tb) >= 20 THEN {r(f'max(price) OVER {_BACK}', 'highest').rpartition(' AS ')[0]} END AS highest FROM hot")
def wn6_sma_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and maxima of twenty rows of two series, each in stretches with the rows before them."""

    def both(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rolling.highest(rolling.sma(rows, 20, by=by, order=_KEY["order"]), 20, by=by, order=_KEY["order"])

    return shown(stretches.in_stretches(_hot(spark, sf_dir), 19, both, width=MONTH, rows=4096, **_KEY), "sid", "ts", "tb", "sma", "highest")


@query(f"{_HOT} SELECT sid, tb, row_number() OVER {_UPTO} AS n, sum(volume) OVER {_UPTO} AS volume, {r(f'max(price) OVER {_UPTO}', 'peak')}, {r(f'min(price) OVER {_UPTO}', 'low')}, {r(f'first_value(price) OVER {_UPTO}', 'begun')} FROM hot")
def pf2_running_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers, sums, peaks, lows and first values of two series, carried from stretch to stretch."""
    c = F.col("close")
    values = {"n": ("count", F.lit(1)), "total": ("sum", F.col("volume")), "peak": ("max", c), "low": ("min", c), "begun": ("first", c)}
    out = stretches.running(_hot(spark, sf_dir), values, width=MONTH, **_KEY)
    return shown(out, "sid", "tb", "n", F.col("total").alias("volume"), "peak", "low", "begun")


@query(f"WITH RECURSIVE ticks AS ({EVENTS}), n AS (SELECT sid, ts, tb, price AS close, row_number() OVER (PARTITION BY sid ORDER BY ts, tb) AS i FROM ticks), s AS (SELECT sid, 14 AS i, avg(close) AS y FROM n WHERE i <= 14 GROUP BY sid), a AS (SELECT sid, i, y FROM s UNION ALL SELECT b.sid, b.i, a.y * (13.0e0 / 15) + (2.0e0 / 15) * b.close FROM a JOIN n b ON b.sid = a.sid AND b.i = a.i + 1) SELECT n.sid, n.tb, {r('a.y', 'ema')} FROM n LEFT JOIN a ON a.sid = n.sid AND a.i = n.i")
def rc1_ema_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential averages of all events by type, with the chunks' maps carried apart from the rows."""
    rows = event_ticks(spark, sf_dir).select("sid", "ts", "tb", F.col("price").alias("close"))
    return shown(recursive.ema(rows, 14, width=6 * 3600, **_KEY), "sid", "tb", "ema")


@query(_bricks(_NUMBERED, 10))
def fl11_renko_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks of events by type: spans of each series are summed up and run on any task."""
    return shown(renko(_as_bars(event_ticks(spark, sf_dir)), tie=("tb",), size=10.0, width=6 * 3600), *_SHOWN)


@query(f"{_NUMBERED}, st AS (SELECT n.*, CASE WHEN tb % 5 = 0 THEN close - 12 END AS stop FROM n WHERE i = 1 UNION ALL SELECT n.*, CASE WHEN st.stop IS NULL THEN CASE WHEN n.tb % 5 = 0 THEN n.close - 12 END WHEN n.close >= st.stop THEN greatest(st.stop, n.close - 12) END FROM st JOIN n ON n.sid = st.sid AND n.i = st.i + 1) SELECT sid, {t()}, tb, (stop IS NOT NULL)::BIGINT AS position, {r('stop')} FROM st")
def sg8_trailing_stop_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-arming stops on events by type: spans of each series are summed up and run on any task."""
    rows = event_ticks(spark, sf_dir).select("sid", "ts", "tb", F.col("price").alias("close"), (F.col("tb") % 5 == 0).alias("go"), F.lit(12.0).alias("gap"))
    return shown(trailing_stop_positions(rows, "go", "gap", tie=("tb",), width=6 * 3600))
