"""Positions and cash from fills: cumulative windows and one affine scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.windows import expanding, series
from ..sources.workdir import stored
from .align import asof
from .scan import affine_scan
from .steps import EventHolding, StrictHolding
from .stepwise import stepwise
from .stretches import running

KEY, ORDER = ("experiment_id", "sid"), ("executed_dt", "order_id")


def position_ledger(fills: DataFrame, *, by: Sequence[str] = KEY, order: Sequence[str] = ORDER, width: int | None = None) -> DataFrame:
    """Fills with size_after and cost_basis.

    A buy averages into the cost; a sell leaves it; a flat position has none.
    cost' = cost size / size' + price bought / size' is affine in the cost.
    With ``width`` sizes run in stretches of that many seconds and the scan is
    spread too (``stretches``, ``scan``), so no task holds a series.
    """
    rows = fills.withColumn("_q", F.when(F.col("is_buy"), F.col("executed_size")).otherwise(-F.col("executed_size")))
    if width is None:
        rows = rows.withColumns({"size_after": F.sum("_q").over(expanding(by, order)), "_i": F.row_number().over(series(by, order))})
    else:
        rows = running(rows, {"size_after": ("sum", F.col("_q")), "_i": ("count", F.lit(1))}, by=by, order=order, width=width)
    before, first = F.col("size_after") - F.col("_q"), F.col("_i") == 1
    opens = (before <= 0) & F.col("is_buy")
    a = F.when(F.col("size_after") == 0, 0.0).when(opens, 0.0).when(F.col("is_buy"), before / F.col("size_after")).otherwise(1.0)
    b = F.when(F.col("size_after") == 0, 0.0).when(opens, F.col("executed_price")).when(F.col("is_buy"), F.col("executed_price") * F.col("executed_size") / F.col("size_after")).otherwise(0.0)
    rows = rows.withColumns({"_a": F.when(first, 0.0).otherwise(a), "_b": F.when(first & ~F.col("is_buy"), 0.0).otherwise(b)})
    return affine_scan(rows, F.col("_a"), F.col("_b"), "cost_basis", by=by, order=order, width=width).drop("_a", "_b", "_q", "_i")


def availability(fills: DataFrame, *, by: Sequence[str] = KEY, order: Sequence[str] = ORDER, width: int | None = None) -> DataFrame:
    """Adds available: what was bought before today less all sells up to and with this fill; ``width`` as in ``position_ledger``."""
    bought = F.when(F.col("is_buy"), F.col("executed_size")).otherwise(0)
    sold = F.when(F.col("is_buy"), 0).otherwise(F.col("executed_size"))
    rows = fills.withColumn("_day", F.to_date(order[0]))
    if width is None:
        # all earlier days, whatever rows today has: a RANGE frame over the day
        earlier = W.partitionBy(*by).orderBy(F.unix_date("_day")).rangeBetween(W.unboundedPreceding, -1)
        out = rows.withColumn("available", (F.coalesce(F.sum(bought).over(earlier), F.lit(0)) - F.sum(sold).over(expanding(by, order))).cast("long"))
    else:
        out = running(rows, {"_bought": ("sum", bought), "_sold": ("sum", sold)}, by=by, order=order, width=width)
        today = F.sum(bought).over(expanding((*by, "_day"), order))
        out = out.withColumn("available", (F.col("_bought") - today - F.col("_sold")).cast("long")).drop("_bought", "_sold")
    return out.drop("_day")


def oversells(fills: DataFrame, **options: object) -> DataFrame:
    """Sells that exceed what was available: to be taken out (an anti join on order_id) and reported."""
    return availability(fills, **options).where((~F.col("is_buy")) & (F.col("available") < 0))


def strict_ledger(fills: DataFrame, *, by: Sequence[str] = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    """(by, order, ignored, size_after, available_after, cost_basis): the ledger that ignores oversells.

    What was bought is available from the next day on.  A sell of more than is
    available is ignored and lowers nothing: later sells may use all of it.
    Whether a sell counts depends on which ones before it did, so each series
    goes through a machine, in ``order``, which should be total.
    """
    rows = fills.withColumn("_day", F.unix_date(F.to_date(order[0])))
    return stepwise(rows, StrictHolding, by=by, ts=order[0], tie=tuple(order[1:]))


def merger_families(instruments: DataFrame) -> DataFrame:
    """(sid, family, steps): the series at the end of each series' chain of mergers, and how far it is.

    Pointer jumping: in every round a series takes its target's target, so a
    chain of n mergers takes log n joins.  Mergers in a circle are an error.
    """
    moves = instruments.where(_moves()).select("sid", F.col("merger").cast(instruments.schema["sid"].dataType).alias("family"))
    links = stored(moves.withColumn("steps", F.lit(1).cast("long")), "mergers")
    count = links.count()
    for _ in range(max(1, count).bit_length() + 1):
        then = links.select(F.col("sid").alias("family"), F.col("family").alias("_next"), F.col("steps").alias("_more"))
        joined = links.join(then, "family", "left")
        links = stored(joined.select("sid", F.coalesce("_next", "family").alias("family"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")), "mergers")
        if not links.join(moves.select(F.col("sid").alias("family")), "family", "left_semi").limit(1).count():
            return links
    raise ValueError("mergers form a circle")


def _moves() -> Column:
    to = F.col("merger").cast("string")
    return F.col("delist").isNotNull() & to.isNotNull() & ~to.isin("", "0") & (F.col("ratio") > 0)


def positions_through_events(
    fills: DataFrame, adjustments: DataFrame, rights: DataFrame, instruments: DataFrame, closes: DataFrame, *, by: Sequence[str] = ("experiment_id",), order: Sequence[str] = ORDER, strict: bool = True,
) -> DataFrame:
    """Positions carried through fills, bonus shares, rights issues, mergers and delistings.

    Tables: ``adjustments`` (sid, day, bonus_share, transfer, bonus), ``rights``
    (sid, day, ratio, price), ``instruments`` (sid, delist, merger, ratio),
    ``closes`` (sid, day, close).  Of a day, adjustments come first, then rights,
    then fills, and at its end delistings, along a chain of mergers from its
    start.  A merger moves the position to its target at the close of the last
    day known by then, and joins what is held there with size-weighted cost;
    without a target it ends.  What was bought is available from the next day;
    with ``strict`` sells of more are ignored.

    One row for every fill and every position that an event changes: (by, day,
    sid, action, size_after, available_after, cost_basis, cash).  Series that
    mergers tie together are one family, found by pointer jumping; a family of
    an experiment goes through one machine, and events reach the experiments
    that trade their family.
    """
    families = merger_families(instruments)

    def tied(df: DataFrame) -> DataFrame:
        out = df.join(families, "sid", "left")
        return out.withColumns({"_family": F.coalesce("family", "sid"), "_step": -F.coalesce("steps", F.lit(0))}).drop("family", "steps")

    blank = {"is_buy": "boolean", "executed_size": "long", "executed_price": "double", "_grow": "double", "_paid": "double", "_price": "double", "_to": instruments.schema["sid"].dataType, order[0]: fills.schema[order[0]].dataType, order[1]: fills.schema[order[1]].dataType}

    def log(df: DataFrame, day: Column, kind: str, rank: int, **values: Column) -> DataFrame:
        given = {k: values.get(k, F.col(k) if kind == "fill" and k in df.columns else F.lit(None)).cast(t).alias(k) for k, t in blank.items()}
        extra = by if kind == "fill" else ()
        return df.select(*extra, "_family", "_step", "sid", F.to_date(day).alias("day"), F.lit(kind).alias("_kind"), F.lit(rank).alias("_rank"), *given.values())

    trades = log(tied(fills), F.col(order[0]), "fill", 2)
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    last = instruments.where("delist is not null")
    seen = closes.join(last.select("sid", F.to_date("delist").alias("_end")), "sid").where(F.to_date("day") <= F.col("_end"))
    last = last.join(seen.groupBy("sid").agg(F.max_by("close", "day").alias("_close")), "sid", "left")
    events = log(tied(adjustments), F.col("day"), "bonus", 0, _grow=1 + (part("bonus_share") + part("transfer")) / 10, _paid=part("bonus") / 10)
    events = events.unionByName(log(tied(rights), F.col("day"), "rights", 1, _grow=1 + part("ratio") / 10, _paid=part("ratio") / 10, _price=part("price")))
    events = events.unionByName(log(tied(last), F.col("delist"), "ended", 3, _grow=F.col("ratio"), _price=F.col("_close"), _to=F.when(_moves(), F.col("merger"))))
    everywhere = events.join(trades.select(*by, "_family").distinct(), "_family")
    rows = trades.unionByName(everywhere.select(*trades.columns)).withColumn("_day", F.unix_date("day"))
    kind = fills.schema["sid"].dataType
    sid = (kind, to_arrow_type(kind))
    out = stepwise(rows, lambda: EventHolding(sid, strict), by=(*by, "_family"), ts="day", tie=("_rank", "_step", *order, "sid"))
    return out.select(*by, "day", "sid", "action", *order, "size_after", "available_after", "cost_basis", "cash")


def mark_to_close(positions: DataFrame, closes: DataFrame, *, ts: str = "day") -> DataFrame:
    """Adds close (the last known) and pnl = size (close - cost)."""
    out = asof(positions, closes, ["close"], by=("sid",), ts=ts)
    return out.withColumn("pnl", F.coalesce(F.col("size") * (F.col("close") - F.col("cost_basis")), F.lit(0.0)))


def apply_bonus(positions: DataFrame, adjustments: DataFrame, on: Sequence[str] = ("sid", "day")) -> DataFrame:
    """Bonus shares and dividends on the ex-day: size and cost rescaled, cash_in paid."""
    out = positions.join(adjustments.select(*on, "bonus_share", "transfer", "bonus"), list(on), "left")
    k = 1 + (F.coalesce("bonus_share", F.lit(0.0)) + F.coalesce("transfer", F.lit(0.0))) / 10
    cash = F.col("size") * F.coalesce("bonus", F.lit(0.0)) / 10
    out = out.withColumns({"_k": k, "cash_in": cash})
    return out.withColumns({"size": F.floor(F.col("size") * F.col("_k")).cast("long"), "cost_basis": F.col("cost_basis") / F.col("_k")}).drop("_k", "bonus_share", "transfer", "bonus")


def apply_rights(positions: DataFrame, rights: DataFrame, on: Sequence[str] = ("sid", "day")) -> DataFrame:
    """Rights issues: cash_in is what they cost (negative), size grows and cost averages."""
    out = positions.join(rights.select(*on, F.col("ratio").alias("_r"), F.col("price").alias("_p")), list(on), "left")
    r, p = F.coalesce(F.col("_r") / 10, F.lit(0.0)), F.coalesce("_p", F.lit(0.0))
    out = out.withColumns({"_r": r, "_p": p})
    r, p = F.col("_r"), F.col("_p")
    out = out.withColumn("cash_in", -F.col("size") * r * p)
    return out.withColumns({"size": F.floor(F.col("size") * (1 + r)).cast("long"), "cost_basis": (F.col("cost_basis") + r * p) / (1 + r)}).drop("_r", "_p")


def apply_mergers(positions: DataFrame, instruments: DataFrame, *, day: str = "day") -> DataFrame:
    """On a series' last day its position moves to the merger's target, or to zero without one."""
    out = positions.join(instruments.select("sid", F.col("delist").alias("_delist"), F.col("merger").alias("_to"), F.col("ratio").alias("_ratio")), "sid", "left")
    ends = F.col("_delist").isNotNull() & (F.col(day) >= F.col("_delist"))
    moves = ends & F.col("_to").isNotNull() & (F.col("_to") != "0") & (F.col("_ratio") > 0)
    return out.select(
        *[c for c in positions.columns if c not in ("sid", "size", "cost_basis")], F.when(moves, F.col("_to")).otherwise(F.col("sid")).alias("sid"),
        F.when(moves, F.floor(F.col("size") * F.col("_ratio"))).when(ends, 0).otherwise(F.col("size")).cast("long").alias("size"),
        F.when(moves, F.col("close") / F.col("_ratio")).otherwise(F.col("cost_basis")).alias("cost_basis"),
    )


def merge_positions(positions: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Rows of one series as one: summed sizes, size-weighted cost."""
    return positions.groupBy(*by).agg(F.sum("size").alias("size"), F.try_divide(F.sum(F.col("size") * F.col("cost_basis")), F.sum("size")).alias("cost_basis"))


def drop_flat(positions: DataFrame) -> DataFrame:
    return positions.where("size <> 0")


def cash_ledger(fills: DataFrame, start_cash: float, events: DataFrame | None = None, *, by: Sequence[str] = ("experiment_id",), order: Sequence[str] = ORDER) -> DataFrame:
    """Cash after every fill and event: start - buys + sells - commission + events (by, ts, amount)."""
    value = F.col("executed_price") * F.col("executed_size")
    flow = F.when(F.col("is_buy"), -value).otherwise(value) - F.coalesce("comm", F.lit(0.0))
    flows = fills.select(*by, F.col(order[0]).alias("ts"), F.col(order[1]).cast("string").alias("ref"), flow.alias("amount"))
    if events is not None:
        flows = flows.unionByName(events.select(*by, "ts", F.lit(None).cast("string").alias("ref"), "amount"))
    return flows.withColumn("cash", start_cash + F.sum("amount").over(expanding(by, ("ts", "ref", "amount"))))


def account_value(positions: DataFrame, by: Sequence[str] = ("experiment_id", "day")) -> DataFrame:
    """portfolio_value (cost and gain of all positions) and pnl by day."""
    return positions.groupBy(*by).agg(F.sum(F.col("size") * F.col("cost_basis") + F.col("pnl")).alias("portfolio_value"), F.sum("pnl").alias("pnl"))
