"""Metric logs, latest-row tables, ledger history and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import carried

#: Rows a file of a written table holds at most.
ROWS_PER_FILE = 5_000_000
#: Conflict keys of the persisted tables.
KEYS: Mapping[str, tuple[str, ...]] = {
    "orders": ("experiment_id", "order_id"),
    "fills": ("experiment_id", "order_id", "executed_dt"),
    "positions": ("experiment_id", "sid", "datetime"),
    "accounts": ("experiment_id", "datetime"),
}


def write_parquet(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "append", compression: str = "none") -> None:
    """Text with a header; ``read_csv`` tells ``gzip`` and other codecs by the files' names."""
    df.write.mode(mode).option("header", True).option("compression", compression).option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """One object a line."""
    df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).json(path)


def metric_log(df: DataFrame, metrics: Sequence[str], ids: Sequence[str] = ("ts",), prefix: str = "") -> DataFrame:
    """Wide columns to (ids, metric, value); nulls and NaN are left out.

    ``prefix`` names indicator lines, as in ``ind_SMA_`` + line.
    """
    value = {m: F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")) for m in metrics}
    lines = F.array(*[F.struct(F.lit(prefix + m).alias("metric"), v.alias("value")) for m, v in value.items()])
    return df.select(*ids, F.inline(lines)).where("value is not null")  # rows stay where they are, unlike with unpivot


def metric_pivot(log: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), need: str = "close", arrival: str = "arrival") -> DataFrame:
    """Last value of each metric by time, wide and carried forward; rows before the first ``need`` go."""
    order = arrival if arrival in log.columns else "value"
    own = {m: F.col("metric") == m for m in metrics}
    wide = log.groupBy(*by, "ts").agg(*[F.max_by(F.when(is_m, F.col("value")), F.when(is_m, F.col(order))).alias(m) for m, is_m in own.items()])
    return carried(wide, list(metrics), by, "ts").dropna(subset=[need])


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: an upsert batch without conflicts."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``current`` with rows of ``batch`` added or, for an equal key, in their place."""
    newest = latest_by_key(batch, keys, order)
    return current.join(newest.select(*keys), list(keys), "left_anti").select(*current.columns).unionByName(newest.select(*current.columns))


def latest_accounts(accounts: DataFrame) -> DataFrame:
    """The newest account row of each experiment."""
    return latest_by_key(accounts, ["experiment_id"], ["datetime"])


def latest_positions(positions: DataFrame) -> DataFrame:
    """The newest position row of each experiment and series."""
    return latest_by_key(positions, ["experiment_id", "sid"], ["datetime"])


def history(df: DataFrame, start: str, end: str, ts: str = "datetime", sids: Sequence[str] | None = None, experiment: str | None = None) -> DataFrame:
    """Rows in a range, optionally of some series and one experiment; sort for display by ``ts`` descending."""
    df = df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if sids is not None:
        df = df.where(F.col("sid").isin(list(sids)))
    return df if experiment is None else df.where(F.col("experiment_id") == experiment)


def order_history(orders: DataFrame, fills: DataFrame, start: str, end: str, sids: Sequence[str] | None = None) -> DataFrame:
    """Orders in a range, each with the list of its fills, newest first."""
    own = fills.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("executed_dt", "executed_size", "executed_price"))).alias("fills"))
    return history(orders, start, end, "created_dt", sids).join(own, "order_id", "left").orderBy(F.col("created_dt").desc(), "order_id")


def write_with_dead_letters(df: DataFrame, path: str, dead_path: str, good: Column) -> None:
    """Rows that fail a check go to ``dead_path`` with the time of writing, the others to ``path``."""
    write_parquet(df.where(F.coalesce(good, F.lit(False))), path)
    write_parquet(df.where(~F.coalesce(good, F.lit(False))).withColumn("failed_at", F.current_timestamp()), dead_path)


def register_run(spark: SparkSession, path: str, experiment_id: str, client: str, strategy: str, parameters: Mapping[str, object]) -> None:
    """Appends one row for a run: client, strategy name and its parameters as text."""
    text = ";".join(f"{k}={parameters[k]}" for k in sorted(parameters))
    spark.createDataFrame([(experiment_id, client, strategy, text)], "experiment_id string, client string, strategy string, parameters string").write.mode("append").parquet(path)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
