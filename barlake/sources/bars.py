"""Readers and shapers of bars and ticks (all lazy; filters reach the scan)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import at_time
from .schema import FIELDS, PRICES


def read_bars(spark: SparkSession, path: str, columns: Sequence[str] = ("sid", "ts", *FIELDS), start: str | None = None, end: str | None = None, sids: Sequence[str] | None = None) -> DataFrame:
    """Parquet bars, only the asked columns, range and series; NaN is read as null."""
    bars = spark.read.parquet(path).select(*columns)
    doubles = {f.name for f in bars.schema if isinstance(f.dataType, T.DoubleType)}
    return select_range(bars, start, end, sids).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in doubles else c for c in columns])


def select_range(df: DataFrame, start: str | None = None, end: str | None = None, sids: Sequence[str] | None = None, ts: str = "ts", sid: str = "sid") -> DataFrame:
    """Rows in start .. end and of the listed series (pushed to the scan)."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    return df if sids is None else df.where(F.col(sid).isin(list(sids)))


def ticks_as_bars(ticks: DataFrame, price: str = "price") -> DataFrame:
    """A price as a bar of its own: open = high = low = close."""
    rest = [c for c in ticks.columns if c != price]
    return ticks.select(*rest, *[F.col(price).alias(p) for p in PRICES])


#: Positions of the columns in a generic file; -1 is absent.
GENERIC = {"date": 0, "time": -1, "open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "openinterest": 6}
TERMINAL = {"date": 0, "time": 1, "open": 2, "high": 3, "low": 4, "close": 5, "volume": 6, "openinterest": -1}
ADJUSTED = {"date": 0, "time": -1, "open": 8, "high": 9, "low": 10, "close": 11, "volume": 12, "openinterest": -1}
UNADJUSTED = {"date": 0, "time": -1, "open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "openinterest": -1}


def read_csv(
    spark: SparkSession, path: str, columns: Mapping[str, int] = GENERIC, date_format: str = "yyyy-MM-dd HH:mm:ss", time_format: str = "HH:mm:ss", header: bool = True, separator: str = ",",
    null_value: float | None = None, session_end: str | None = None, width: int | None = None,
) -> DataFrame:
    """Text bars by position.

    ``date_format`` may be ``epoch`` (seconds, whole or not).  A date without
    time is raised to ``session_end`` if given.  Empty fields become
    ``null_value``; a column at -1 is null.  The file may be in any order.
    Other names in ``columns`` are numbers and follow under their names.
    """
    n = width or max(columns.values()) + 1
    raw = spark.read.csv(path, header=header, sep=separator, schema=T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(n)]), enforceSchema=True)

    def field(name: str) -> Column:
        at = columns.get(name, -1)
        return F.when(F.trim(F.col(f"_{at}")) != "", F.trim(F.col(f"_{at}"))) if at >= 0 else F.lit(None).cast("string")

    if date_format == "epoch":
        ts = F.timestamp_micros((field("date").cast("double") * 1_000_000).cast("long"))
    elif columns.get("time", -1) >= 0:
        ts = F.try_to_timestamp(F.concat_ws("T", field("date"), field("time")), F.lit(f"{date_format}'T'{time_format}"))
    else:
        ts = F.try_to_timestamp(field("date"), F.lit(date_format))
    if session_end is not None:
        ts = F.greatest(ts, at_time(F.to_date(ts), session_end))
    names = dict.fromkeys((*PRICES, "volume", "openinterest", *[c for c in columns if c not in ("date", "time")]))
    return raw.select(ts.alias("ts"), *[F.coalesce(field(c).cast("double"), F.lit(null_value)).alias(c) for c in names])


def read_fixed_csv(spark: SparkSession, path: str, session_end: str = "23:59:59", with_time: bool = False) -> DataFrame:
    """``YYYY-MM-DD[,HH:MM:SS],O,H,L,C,V,OI`` with a header; without time at the session's end."""
    if with_time:
        return read_csv(spark, path, {k: v + (k not in ("date", "time")) for k, v in GENERIC.items()} | {"time": 1}, "yyyy-MM-dd")
    return read_csv(spark, path, GENERIC, "yyyy-MM-dd", session_end=session_end)


def read_terminal_csv(spark: SparkSession, path: str) -> DataFrame:
    """``YYYY.MM.DD,HH:MM,O,H,L,C,V`` without a header."""
    return read_csv(spark, path, TERMINAL, "yyyy.MM.dd", "HH:mm", header=False)


def read_adjusted_csv(spark: SparkSession, path: str, adjusted: bool = True, decimals: int | None = None, session_end: str | None = None, raw: Sequence[str] = ()) -> DataFrame:
    """Thirteen columns: raw prices at 1-5 and adjusted ones at 8-12; optionally rounded.

    ``raw`` names fields whose raw values are read in the same pass, as ``raw_close``.
    """
    columns = (ADJUSTED if adjusted else UNADJUSTED) | {f"raw_{c}": UNADJUSTED[c] for c in raw}
    bars = read_csv(spark, path, columns, "yyyy-MM-dd", session_end=session_end, width=13)
    prices = [*PRICES, *[f"raw_{c}" for c in raw if c in PRICES]]
    return bars if decimals is None else bars.withColumns({c: F.round(c, decimals) for c in prices})


def map_columns(df: DataFrame, mapping: Mapping[str, str | int | None], nocase: bool = True) -> DataFrame:
    """Columns by name (in any case), by position, or absent (None: null)."""

    def source(key: str | int | None) -> Column:
        if key is None:
            return F.lit(None).cast("double")
        if isinstance(key, int):
            return df[df.columns[key]]
        exact = [c for c in df.columns if c == key] or [c for c in df.columns if nocase and c.lower() == key.lower()]
        return df[exact[0]]

    return df.select(*[source(v).alias(k) for k, v in mapping.items()])


def chain(feeds: Sequence[DataFrame], by: Sequence[str] = ("sid",), ts: str = "ts") -> DataFrame:
    """Feeds one after another: a later feed adds only what lies beyond all earlier ones of its series."""
    ranked = reduce(lambda a, b: a.unionByName(b), [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(feeds)])
    last = ranked.groupBy(*by, "_rank").agg(F.max(ts).alias("_last"))
    seen = last.withColumn("_seen", F.max("_last").over(W.partitionBy(*by).orderBy("_rank").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    return ranked.join(seen, [*by, "_rank"]).where(F.col("_seen").isNull() | (F.col(ts) > F.col("_seen"))).select(*feeds[0].columns)


def advance_only(df: DataFrame, by: Sequence[str] = ("sid",), ts: str = "ts", arrival: Sequence[str] = ()) -> DataFrame:
    """The first arrival of each time of a series; later rows of the same time are dropped."""
    w = W.partitionBy(*by, ts).orderBy(*(arrival or df.columns))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def time_mean(bars: DataFrame, seconds: int, by: Sequence[str] = ("sid",), ts: str = "ts", fields: Sequence[str] = (*PRICES, "volume")) -> DataFrame:
    """Mean of each field by time unit; empty units are absent."""
    slot = F.timestamp_seconds((F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds).cast("long"))
    return bars.groupBy(*by, slot.alias(ts)).agg(*[F.avg(c).alias(c) for c in fields])


def quote_side(quotes: DataFrame, use_ask: bool = False, bid_ask: bool = True) -> DataFrame:
    """Bars from bid and ask columns (``open_bid``, ``open_ask`` ...): one side, or the middle."""
    side = "ask" if use_ask else "bid"
    rest = [c for c in quotes.columns if c.rpartition("_")[2] not in ("bid", "ask")]
    return quotes.select(*rest, *[(F.col(f"{p}_{side}") if bid_ask else (F.col(f"{p}_bid") + F.col(f"{p}_ask")) / 2).alias(p) for p in PRICES])


def matrix_to_long(wide: DataFrame, field: str, sid: str = "sid", scale: float | None = None, zero_is_null: bool = True) -> DataFrame:
    """One row a series and one column a day (YYYYMMDD) to (sid, day, field); scaled integers are decoded."""
    days = [c for c in wide.columns if c != sid]
    long = wide.unpivot([sid], days, "day", "_v").withColumn("day", F.to_date("day", "yyyyMMdd"))
    value = F.nullif("_v", F.lit(0)) if zero_is_null else F.col("_v")
    return long.select(sid, "day", (value / F.lit(scale) if scale else value).cast("double").alias(field))


def encode_scaled(value: Column, scale: float) -> Column:
    """round(value * scale), 0 for null: the inverse of the decoding above."""
    return F.coalesce(F.round(value * scale), F.lit(0)).cast("long")


def lifetimes(bars: DataFrame, fields: Sequence[str] = FIELDS, day: str = "day") -> DataFrame:
    """First and last day of each series on which any field is known."""
    return bars.where(F.coalesce(*fields).isNotNull()).groupBy("sid").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def last_traded(queries: DataFrame, bars: DataFrame, day: str = "day") -> DataFrame:
    """(sid, day) of ``queries`` with the latest day up to it that has volume; null if none."""
    traded = bars.where("volume <> 0").select("sid", F.col(day).alias("_day"), F.col(day).alias("_traded"))
    asked = queries.select("sid", F.col(day).alias("_day"), F.lit(None).cast(bars.schema[day].dataType).alias("_traded"))
    both = traded.withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)))
    w = W.partitionBy("sid").orderBy("_day", "_asked").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("last_traded", F.last("_traded", True).over(w)).where("_asked = 1").select("sid", F.col("_day").alias(day), "last_traded")


def lookup(queries: DataFrame, bars: DataFrame, field: str, day: str = "day") -> DataFrame:
    """The field at (sid, day) and why it is missing: unknown series, before start, after end, no data."""
    found = queries.join(lifetimes(bars, day=day), "sid", "left").join(bars.select("sid", day, field), ["sid", day], "left")
    status = (
        F.when(F.col("first_day").isNull(), "unknown").when(F.col(day) < F.col("first_day"), "before_start").when(F.col(day) > F.col("last_day"), "after_end")
        .when(F.col(field).isNull(), "no_data").otherwise("ok")
    )
    return found.select(*queries.columns, field, status.alias("status"))


def close_snapshot(bars: DataFrame, at: str, sids: Sequence[str] | None = None) -> DataFrame:
    """The first close of each series at a time."""
    rows = select_range(bars, at, at, sids)
    return rows.groupBy("sid").agg(F.min_by("close", F.struct(*[c for c in rows.columns if c not in ("sid", "close")])).alias("close"))


def forward_adjust(bars: DataFrame, factors: DataFrame, day: str = "day") -> DataFrame:
    """Prices before an ex-day times its factor, volumes divided by it; from the ex-day on unchanged.

    ``factors`` is (sid, day, factor), of several rows on a day the product.
    A bar takes the product of the factors of all later ex-days, found by one
    window over bars and factors together, so ex-days without a bar count too.
    """
    per_day = factors.groupBy("sid", day).agg(F.product("factor").alias("_f"))
    marks = per_day.select("sid", day, "_f", F.lit(0).alias("_bar"))
    rows = bars.withColumns({"_f": F.lit(None).cast("double"), "_bar": F.lit(1)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    later = W.partitionBy("sid").orderBy(F.col(day).desc(), F.col("_bar").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    k = F.coalesce(F.product("_f").over(later), F.lit(1.0))
    out = both.withColumn("_k", k).where("_bar = 1")
    return out.withColumns({c: F.col(c) * F.col("_k") for c in PRICES} | {"volume": F.col("volume") / F.col("_k")}).select(*bars.columns)
