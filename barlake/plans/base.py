"""Domain tables derived from the given ones, the query registry and SQL text for the same tables.

Ticks are line items (series: supplier, time: ship date, price: extended price
by quantity) and events (series: event type).  Every query shows times as text
and doubles rounded to six places, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.resample import resample
from ..sources.bars import ticks_as_bars

#: Added before rounding on both sides: prices are often exact halves in the last place, which two engines round differently.
SHIFT = 3e-8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def shown(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns with times and dates as text and doubles rounded."""
    df = df.select(*columns) if columns else df
    kinds = {f.name: f.dataType for f in df.schema}

    def one(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), kinds[name]
        if isinstance(kind, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
        if isinstance(kind, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(name)
        if isinstance(kind, T.DoubleType):
            return (F.round(c + F.lit(SHIFT), 6) + F.lit(0.0)).alias(name)
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("long").alias(name)
        return c

    return df.select(*[one(c) for c in df.columns])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, ts, tb, price, volume, amount): line items by supplier."""
    li = table(spark, sf_dir, "lineitem")
    tb = F.col("l_orderkey") * 10_000_000_000 + F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")
    return li.select(F.col("l_suppkey").alias("sid"), F.col("l_shipdate").alias("ts"), tb.alias("tb"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount"))


def day_bars(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Supplier bars by ship date.

    Hardly two line items share a bar, so partial bars save no rows and are wider than line items.  With ``dealt``
    line items are dealt by series, in more and smaller tasks, and what follows by series needs no other shuffle.
    """
    rows = ticks(spark, sf_dir)
    if dealt:
        rows = rows.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "sid")
    return resample(ticks_as_bars(rows), "days", tie=("tb",))


def month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier bars by month, stamped with the last ship date."""
    return resample(ticks_as_bars(ticks(spark, sf_dir)), "months", tie=("tb",))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, ts, tb, price, volume, amount): events by type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("sid"), "ts", F.col("event_id").alias("tb"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("value").alias("amount"))


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event bars by right-closed hour."""
    return resample(ticks_as_bars(event_ticks(spark, sf_dir)), "hours", tie=("tb",))


# --- the same tables in SQL ---------------------------------------------------

TICKS = "SELECT l_suppkey AS sid, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_extendedprice AS amount, l_orderkey * 10000000000 + l_linenumber::BIGINT * 1000000000 + l_partkey AS tb FROM lineitem"
_FIELDS = "max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(volume) AS volume, sum(amount) AS amount"
_KEYED = "SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, tb) AS k FROM ticks"
DAYS = f"WITH RECURSIVE ticks AS ({TICKS}), keyed AS ({_KEYED}), bars AS (SELECT sid, ts, arg_min(price, k) AS open, {_FIELDS} FROM keyed GROUP BY sid, ts) "
MONTHS = f"WITH RECURSIVE ticks AS ({TICKS}), keyed AS ({_KEYED}), bars AS (SELECT sid, max(ts) AS ts, arg_min(price, k) AS open, {_FIELDS} FROM keyed GROUP BY sid, date_trunc('month', ts)) "
EVENTS = "SELECT event_type AS sid, ts, event_id AS tb, value AS price, 1.0e0 AS volume, value AS amount FROM events"


def edge(ts: str, seconds: int) -> str:
    """End of the right-closed bucket of a time."""
    return f"make_timestamp(epoch_us(date_trunc('day', {ts})) + ceil((epoch_us({ts}) - epoch_us(date_trunc('day', {ts}))) / {seconds * 1_000_000}.0e0)::BIGINT * {seconds * 1_000_000})"


HOURS = f"WITH RECURSIVE ticks AS ({EVENTS}), keyed AS ({_KEYED}), bars AS (SELECT sid, {edge('ts', 3600)} AS ts, arg_min(price, k) AS open, {_FIELDS} FROM keyed GROUP BY sid, {edge('ts', 3600)}) "


def r(x: str, name: str | None = None) -> str:
    """A double as shown."""
    return f"round(({x}) + {SHIFT}, 6) + 0.0e0 AS {name or x}"


def t(x: str = "ts", name: str | None = None) -> str:
    """A time as shown."""
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {name or x}"


def d(x: str, name: str | None = None) -> str:
    """A date as shown."""
    return f"strftime({x}, '%Y-%m-%d') AS {name or x}"


def warm(x: str, n: int) -> str:
    """Null before row n of the series."""
    return f"CASE WHEN row_number() OVER s >= {n} THEN {x} END"


S = "WINDOW s AS (PARTITION BY sid ORDER BY ts)"
OHLC = ", ".join(r(x) for x in ("open", "high", "low", "close", "volume", "amount"))


def last(n: int) -> str:
    return f"(PARTITION BY sid ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


UPTO = "(PARTITION BY sid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
