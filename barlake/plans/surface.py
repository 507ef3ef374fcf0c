"""Queries of file presets, sinks, market hours, the user surface and live hand-over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import registry
from ..functions import exprs
from ..functions.buckets import market_close, market_open
from ..operators import align, calendar, ledger, resample, signals
from ..sources import bars as src
from ..sources import sinks
from ..sources.upserts import UpsertTable
from ..sources.workdir import new_folder
from ..streaming import live
from .base import DAYS, EVENTS, MONTHS, S, UPTO, d, day_bars, event_ticks, month_bars, query, r, shown, t, table, ticks
from .indicators import _MACD
from .portfolio import _FILLS, _fills
from .streams import _run, _stream

_OHLC = ", ".join(r(x) for x in ("open", "high", "low", "close"))

# --- file presets ---------------------------------------------------------------------


def _dated(spark: SparkSession, sf_dir: str, form: str, dealt: bool = False) -> DataFrame:
    return day_bars(spark, sf_dir, dealt).withColumn("date", F.date_format("ts", form))


@query(f"{DAYS}SELECT sid, {t('ts + INTERVAL 15 HOUR', 'ts')}, {_OHLC}, {r('volume')} FROM bars")
def src4_fixed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in the seven-field layout and back."""
    path = new_folder(spark, "fixed")
    sinks.write_csv(_dated(spark, sf_dir, "yyyy-MM-dd").select("date", "open", "high", "low", "close", "volume", "sid"), path)
    return shown(src.read_fixed_csv(spark, path, "15:00:00").select(F.col("openinterest").cast("long").alias("sid"), "ts", "open", "high", "low", "close", "volume"))


@query(f"{DAYS}SELECT sid, {t('ts + INTERVAL 15 HOUR', 'ts')}, {_OHLC} FROM bars")
def src5_terminal_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in the terminal's layout (no header, points in the date) and back."""
    path = new_folder(spark, "terminal")
    _dated(spark, sf_dir, "yyyy.MM.dd").select("date", F.lit("15:00"), "open", "high", "low", "close", "sid").write.csv(path)
    return shown(src.read_terminal_csv(spark, path).select(F.col("volume").cast("long").alias("sid"), "ts", "open", "high", "low", "close"))


@query(f"{DAYS}SELECT sid, {t()}, {r('open / 2', 'open')}, {r('high / 2', 'high')}, {r('low / 2', 'low')}, {r('close / 2', 'close')}, {r('close', 'raw_close')} FROM bars")
def src6_adjusted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in the layout of thirteen fields; adjusted and raw prices are read from the same files, in one pass."""
    path = new_folder(spark, "adjusted")
    half = [(F.col(c) / 2).alias(f"adj_{c}") for c in ("open", "high", "low", "close")]
    bars = _dated(spark, sf_dir, "yyyy-MM-dd", dealt=True)
    sinks.write_csv(bars.select("date", "open", "high", "low", "close", F.col("sid").alias("v"), F.lit(0), F.lit(1), *half, "sid"), path, compression="gzip")
    back = src.read_adjusted_csv(spark, path, raw=("close",))
    return shown(back, F.col("volume").cast("long").alias("sid"), "ts", "open", "high", "low", "close", "raw_close")


@query(f"{DAYS}SELECT sid, {t()}, {r('open', 'first')}, {r('close', 'price')}, NULL::DOUBLE AS openinterest FROM bars")
def src7_mapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by name in any case, by place, and absent."""
    return shown(src.map_columns(day_bars(spark, sf_dir), {"sid": "SID", "ts": 1, "first": "Open", "price": "CLOSE", "openinterest": None}))


@query(f"{DAYS}SELECT sid, {t()}, round(close * 100)::BIGINT AS coded, {r('round(close * 100) / 100', 'decoded')} FROM bars")
def src13_encode_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = day_bars(spark, sf_dir).withColumn("coded", src.encode_scaled(F.col("close"), 100.0))
    return shown(coded.withColumn("decoded", F.col("coded") / 100.0), "sid", "ts", "coded", "decoded")


# --- sinks ------------------------------------------------------------------------------


@query(f"{DAYS}SELECT sid, {t()}, {_OHLC} FROM bars")
def snk3_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "jsonl")
    bars = day_bars(spark, sf_dir).select("sid", "ts", "open", "high", "low", "close")
    sinks.write_jsonl(bars, path)
    return shown(spark.read.schema(bars.schema).json(path))


@query("SELECT o_custkey AS experiment_id, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice, 2) + 0.0e0 AS portfolio_value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) = 1")
def snk7_latest_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("experiment_id"), F.col("o_orderdate").alias("datetime"), F.col("o_totalprice").alias("portfolio_value"))
    return sinks.latest_accounts(accounts).select("experiment_id", F.date_format("datetime", "yyyy-MM-dd").alias("day"), (F.round("portfolio_value", 2) + F.lit(0.0)).alias("portfolio_value"))


@query(f"{DAYS}SELECT sid, {t()}, {r('close')}, volume > 20 AS good FROM bars")
def snk10_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of little volume beside the others, each marked with when it failed."""
    path, dead = new_folder(spark, "good"), new_folder(spark, "dead")
    bars = day_bars(spark, sf_dir).select("sid", "ts", "close", "volume")
    sinks.write_with_dead_letters(bars, path, dead, F.col("volume") > 20)
    good = spark.read.schema(bars.schema).parquet(path).withColumn("good", F.lit(True))
    failed = spark.read.schema(bars.schema.add("failed_at", T.TimestampType())).parquet(dead)
    return shown(good.unionByName(failed.withColumn("good", F.col("failed_at").isNull()).drop("failed_at")), "sid", "ts", "close", "good")


@query("SELECT 'run' AS experiment_id, 'batch' AS client, 'cross' AS strategy, 'fills=' || count(*) || ';series=' || count(DISTINCT l_suppkey) AS parameters FROM lineitem")
def snk11_register_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run registered with what it has read."""
    found = ticks(spark, sf_dir).agg(F.count("*").alias("fills"), F.countDistinct("sid").alias("series")).first()
    path = new_folder(spark, "runs")
    sinks.register_run(spark, path, "run", "batch", "cross", found.asDict())
    return spark.read.parquet(path)


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, {t()}, tb, {r('price')} FROM ticks QUALIFY row_number() OVER (PARTITION BY sid ORDER BY ts DESC, tb DESC) = 1")
def snk6_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, upserted by a stream."""
    path, keys, order = new_folder(spark, "versions"), ("sid",), ("ts", "tb")
    rows = _stream(spark, sf_dir).select("sid", "ts", "tb", "price")
    live.upsert_stream(rows, path, new_folder(spark, "versions-state"), keys, order).awaitTermination()
    return shown(UpsertTable(spark, path, keys, order).read(spark.createDataFrame([], rows.schema)), "sid", "ts", "tb", "price")


_SPLITS = ("2024-01-08", "2024-01-16", "2024-01-24", "2100-01-01")


def _staged(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame], None]) -> None:
    """All events in four micro-batches by time; the stream is stopped after each."""
    rows, source, before = event_ticks(spark, sf_dir).select("sid", "ts", "tb", "price"), new_folder(spark, "staged"), "1900-01-01"
    for cut in _SPLITS:
        rows.where((F.col("ts") >= F.lit(before).cast("timestamp")) & (F.col("ts") < F.lit(cut).cast("timestamp"))).write.mode("append").parquet(source)
        run(live.stream_ticks(spark, source, rows.schema))
        before = cut


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, tb % 500 AS slot, {t()}, tb, {r('price')} FROM ticks QUALIFY row_number() OVER (PARTITION BY sid, tb % 500 ORDER BY ts DESC, tb DESC) = 1")
def snk6_upsert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of many keys over four micro-batches, merged into a snapshot after every second one."""
    path, keys, order, state = new_folder(spark, "versions"), ("sid", "slot"), ("ts", "tb"), new_folder(spark, "versions-state")

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("sid", (F.col("tb") % 500).alias("slot"), "ts", "tb", "price")

    _staged(spark, sf_dir, lambda rows: live.upsert_stream(keyed(rows), path, state, keys, order, parts=2).awaitTermination())
    like = keyed(event_ticks(spark, sf_dir))
    return shown(UpsertTable(spark, path, keys, order).read(like), "sid", "slot", "ts", "tb", "price")


@query(f"WITH ticks AS ({EVENTS}) SELECT sid, {t()}, tb, ts >= TIMESTAMP '2024-01-24' AS dead FROM ticks")
def snk10_dead_letter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that takes events up to a day: the micro-batch beyond it goes to dead letters, the others are kept."""
    path, dead, state = new_folder(spark, "taken"), new_folder(spark, "dead"), new_folder(spark, "taken-state")

    def take(batch: DataFrame, batch_id: int) -> None:
        if batch.where("ts >= timestamp '2024-01-24'").limit(1).count():
            raise ValueError("the table ends on 24 January")
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _staged(spark, sf_dir, lambda rows: live.dead_letter_stream(rows, take, dead, state).awaitTermination())
    like = event_ticks(spark, sf_dir).select("sid", "ts", "tb", "price").schema
    taken = spark.read.schema(like).parquet(path).withColumn("dead", F.lit(False))
    failed = spark.read.schema(T.StructType([*like, T.StructField("error", T.StringType())])).parquet(dead)
    return shown(taken.unionByName(failed.withColumn("dead", F.contains("error", F.lit("ends on"))).drop("error")), "sid", "ts", "tb", "dead")


# --- hours, bindings, checks ----------------------------------------------------------------


@query(f"SELECT DISTINCT {d('o_orderdate', 'day')}, {t('o_orderdate::DATE + INTERVAL 570 MINUTE', 'open_ts')}, {t('o_orderdate::DATE + INTERVAL 900 MINUTE', 'close_ts')} FROM orders")
def cal5_market_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return shown(days.select("day", market_open(F.col("day")).alias("open_ts"), market_close(F.col("day")).alias("close_ts")))


@query(f"{DAYS}SELECT sid, {t()}, {r('close', 'bound')}, CASE WHEN volume - 10 <> 0 THEN 1.0e0 ELSE 0.0e0 END AS truth FROM bars")
def ex17_line_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value bound to another name, and a number taken as a truth value."""
    return shown(day_bars(spark, sf_dir).select("sid", "ts", F.col("close").alias("bound"), exprs.truth(F.col("volume") - 10).alias("truth")))


@query("SELECT l.l_orderkey AS order_id, l.l_linenumber::BIGINT AS line FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')")
def jn6_orphan_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills whose order is not among the finished or open ones."""
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"))
    return align.orphan_fills(fills, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("order_id"))).select("order_id", "line")


@query(f"WITH {_FILLS}, n AS (SELECT *, sum(CASE WHEN is_buy THEN 0 ELSE q END) OVER (PARTITION BY experiment_id, sid ORDER BY executed_dt, order_id ROWS UNBOUNDED PRECEDING) AS sold, coalesce(sum(CASE WHEN is_buy THEN q ELSE 0 END) OVER (PARTITION BY experiment_id, sid ORDER BY executed_dt RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS bought FROM fills) SELECT order_id, (bought - sold)::BIGINT AS available FROM n WHERE NOT is_buy AND bought < sold")
def tx17_oversells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.oversells(_fills(spark, sf_dir)).select("order_id", "available")


@query(f"{_MACD} SELECT nb.sid, {t('nb.ts', 'ts')}, {r('md.m - h.y', 'histogram')} FROM nb LEFT JOIN md ON nb.sid = md.sid AND nb.rn = md.rn LEFT JOIN h ON nb.sid = h.sid AND nb.rn = h.rn")
def sg5_macd_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(signals.macd_signal(month_bars(spark, sf_dir), "histogram"), "sid", "ts", "histogram")


# --- bars closed by a calendar ------------------------------------------------------------------


def _closed(unit: str) -> str:
    days = "days AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE isodow(l_shipdate) < 5)"
    closes = f"cl AS (SELECT max(day) AS day FROM days GROUP BY date_trunc('{unit}', day))"
    keyed = "keyed AS (SELECT ticks.*, cl.day AS close_day, row_number() OVER (PARTITION BY sid ORDER BY ts, tb) AS k FROM ticks ASOF LEFT JOIN cl ON ticks.ts::DATE <= cl.day)"
    base = DAYS.partition(", keyed AS")[0]
    return f"{base}, {days}, {closes}, {keyed} SELECT sid, {t('max(ts)::DATE + INTERVAL 15 HOUR', 'ts')}, {r('arg_min(price, k)', 'open')}, {r('max(price)', 'high')}, {r('min(price)', 'low')}, {r('arg_max(price, k)', 'close')}, {r('sum(volume)', 'volume')} FROM keyed GROUP BY sid, close_day"


def _calendar_bars(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """Bars that end with the last trading day of a period; the calendar has no Fridays, whose rows open the next bar."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).where(F.weekday("l_shipdate") < 4).distinct()
    closes = calendar.period_closes(days).where(f"last_of_{period}").select("day")
    bars = resample.calendar_bars(src.ticks_as_bars(ticks(spark, sf_dir)), closes, tie=("tb",), session_end="15:00:00")
    return shown(bars, "sid", "ts", "open", "high", "low", "close", "volume")


@query(_closed("week"))
def rs5_calendar_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar_bars(spark, sf_dir, "week")


@query(_closed("month"))
def rs6_calendar_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar_bars(spark, sf_dir, "month")


# --- user surface ----------------------------------------------------------------------------------


def _own(name: str, apply: Callable[..., DataFrame], min_period: int = 1, kind: str = "indicator") -> registry.Operator:
    """The operator of a name, registered by the first query that needs it."""
    try:
        return registry.get(name)
    except KeyError:
        return registry.register(name, apply, min_period, kind)


@query(f"{DAYS}SELECT sid, {t()}, {r('high - low', 'span')}, CASE WHEN row_number() OVER s >= 5 THEN round(avg(high - low) OVER (PARTITION BY sid ORDER BY ts ROWS 4 PRECEDING) + 3e-08, 6) + 0.0e0 END AS mean_span FROM bars {S}")
def uf1_user_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered indicators, the second over the first, null before their joint warm-up."""
    from ..operators.rolling import sma

    first = _own("span", lambda df: df.withColumn("span", F.col("high") - F.col("low")))
    _own("mean_span", lambda df: sma(df, 5, "span", "mean_span"), registry.added(first.min_period, 5))
    return shown(registry.run(day_bars(spark, sf_dir), ["span", "mean_span"]), "sid", "ts", "span", "mean_span")


@query(f"{MONTHS}SELECT sid, count(*) AS months, {r('max(close) / min(close)', 'reach')} FROM bars GROUP BY sid")
def uf5_user_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    _own("reach", lambda df: df.groupBy("sid").agg(F.count("*").alias("months"), (F.max("close") / F.min("close")).alias("reach")), kind="analyzer")
    return shown(registry.run(month_bars(spark, sf_dir), ["reach"]))


@query("SELECT o_orderkey, (floor(sqrt(o_totalprice)) * 2)::BIGINT AS size FROM orders")
def uf6_user_sizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    _own("root_lots", lambda df: df.withColumn("size", (F.floor(F.sqrt("o_totalprice")) * 2).cast("long")), kind="sizer")
    return registry.run(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["root_lots"]).select("o_orderkey", "size")


@query(f"SELECT o_orderkey, {t('o_orderdate', 'parsed')} FROM orders")
def uf7_time_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days as text of the form day/month/year, read by a user's parser."""
    from datetime import datetime

    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("text"))
    return shown(texts.select("o_orderkey", registry.parse_times(F.col("text"), lambda x: datetime.strptime(x, "%d/%m/%Y")).alias("parsed")))


@query("SELECT event_id, event_type, round(value, 6) + 0.0e0 AS value FROM events")
def uf8_user_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a user's feed, the table's row groups in four parts on executors."""
    path, parts = f"{sf_dir}/events.parquet", 4

    def load(part: int) -> Iterator[tuple]:
        import pyarrow.dataset as ds

        groups = [g for f in ds.dataset(path).get_fragments() for g in f.split_by_row_group()]
        for group in groups[part::parts]:  # a part reads its own row groups and no others
            for batch in group.to_batches(columns=["event_id", "event_type", "value"], batch_size=4096):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    spark.dataSource.register(registry.feed_source("events_feed", schema, parts, load))
    return spark.read.format("events_feed").load().withColumn("value", F.round("value", 6) + F.lit(0.0))


# --- live hand-over ----------------------------------------------------------------------------------

@query(f"WITH ticks AS ({EVENTS}), k AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS mark FROM ticks) SELECT sid, {t('mark', 'trigger_ts')}, count(*) AS n, {t('max(ts)', 'last_ts')} FROM k GROUP BY sid, mark HAVING mark <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)")
def st8_periodic_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric row a series every six hours."""
    return shown(_run(spark, live.periodic_triggers(_stream(spark, sf_dir), "6 hours"), "periodic"))
