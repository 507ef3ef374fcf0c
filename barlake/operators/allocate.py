"""Daily selection, weights and the rebalance plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily_top_k(scores: DataFrame, k: int = 6, above: float | None = None, *, day: str = "day", score: str = "score", sid: str = "sid") -> DataFrame:
    """The ``k`` best scores of each day with their rank, ties by sid."""
    rows = scores if above is None else scores.where(F.col(score) > above)
    rank = F.row_number().over(W.partitionBy(day).orderBy(F.col(score).desc_nulls_last(), sid))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_lists(ranked: DataFrame, *, day: str = "day", score: str = "score", sid: str = "sid") -> DataFrame:
    """One row a day with the list of its picks in rank order."""
    return ranked.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("rank", sid, score))).alias("picks"))


def equal_weight(picks: DataFrame, stake: float = 1.0, *, day: str = "day") -> DataFrame:
    return picks.withColumn("weight", F.lit(stake) / F.count("*").over(W.partitionBy(day)))


def score_weight(picks: DataFrame, stake: float = 1.0, *, day: str = "day", score: str = "score") -> DataFrame:
    """Weights in proportion to the positive part of the score; 0 if no score is positive."""
    positive = F.greatest(F.col(score), F.lit(0.0))
    return picks.withColumn("weight", F.coalesce(stake * F.try_divide(positive, F.sum(positive).over(W.partitionBy(day))), F.lit(0.0)))


def volatility_weight(picks: DataFrame, stake: float = 1.0, risk: float = 0.01) -> DataFrame:
    """stake risk close / atr."""
    return picks.withColumn("weight", F.try_divide(stake * risk * F.col("close"), F.col("atr")))


def percent_size(cash: Column, price: Column, percent: float = 0.2) -> Column:
    """floor(cash percent / price)."""
    return F.floor(F.try_divide(cash * percent, price))


#: No purchase is planned at or below this much cash.
LEAST_CASH = 10_000.0


def rebalance_plan(
    held: DataFrame, ranked: DataFrame, accounts: DataFrame, *, slots: int = 6, hold_days: int = 5, stop_ratio: float = 0.9, most_drawdown: float = 0.2, least_cash: float = LEAST_CASH, by: tuple[str, ...] = ("experiment_id", "day")
) -> DataFrame:
    """(by, sid, action, reason, priority): what to sell and buy on each day.

    ``held`` has sid, price, cost_basis, days_held; ``ranked`` has day, sid,
    score, rank; ``accounts`` has drawdown and cash.  A drawdown at its limit
    sells all; a price at or below ``stop_ratio`` of its cost sells first; a
    series held long enough and no longer ranked is sold; the best ranked
    series that are not held or stopped fill the free slots if there is cash.
    """
    by = list(by)
    joined = held.join(accounts.select(*by, "drawdown", "cash"), by).join(ranked.select("day", "sid", "rank"), ["day", "sid"], "left")
    stopped = F.try_divide(F.col("price"), F.col("cost_basis")) <= stop_ratio
    reason = (
        F.when(F.col("drawdown") >= most_drawdown, "drawdown").when(stopped, "stop").when((F.col("days_held") >= hold_days - 1) & F.col("rank").isNull(), "expired")
    )
    sells = joined.withColumn("reason", reason).where("reason is not null")
    sells = sells.select(*by, "sid", F.lit("sell").alias("action"), "reason", F.when(F.col("reason") == "stop", 0).otherwise(1).alias("priority"))
    counts = held.groupBy(*by).agg(F.count("*").alias("_held"))
    gone = sells.groupBy(*by).agg(F.count("*").alias("_sold"))
    able = accounts.where((F.col("drawdown") < most_drawdown) & (F.col("cash") > least_cash)).join(counts, by, "left").join(gone, by, "left")
    able = able.select(*by, (slots - F.coalesce("_held", F.lit(0)) + F.coalesce("_sold", F.lit(0))).alias("_free"))
    # what is held now, sold or not, is not bought on the same day
    wanted = able.join(ranked, "day").join(held.select(*by, "sid"), [*by, "sid"], "left_anti")
    turn = F.row_number().over(W.partitionBy(*by).orderBy("rank", "sid"))
    buys = wanted.withColumn("_turn", turn).where(F.col("_turn") <= F.col("_free"))
    return sells.unionByName(buys.select(*by, "sid", F.lit("buy").alias("action"), F.lit("ranked").alias("reason"), (F.col("_turn") + 1).cast("int").alias("priority")))


def pending_sells(planned: DataFrame, fills: DataFrame) -> DataFrame:
    """Planned sizes less all fills so far; finished orders are gone."""
    done = fills.groupBy("order_id").agg(F.sum("executed_size").alias("_done"))
    left = planned.join(done, "order_id", "left").withColumn("remaining", F.col("size") - F.coalesce("_done", F.lit(0)))
    return left.where("remaining > 0").drop("_done")
