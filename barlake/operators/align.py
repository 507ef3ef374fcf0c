"""Alignment of series: as-of joins by union, shared clocks, lookups and membership."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import BY, carried


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], *, by: Sequence[str] = BY, ts: str = "ts", strict: bool = False, forward: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """``left`` with the latest ``values`` of ``right`` at or before its time; null before the first.

    ``strict`` takes only earlier ones (no look-ahead on equal stamps);
    ``forward`` takes the first at or after.  Both sides go through one window,
    sorted once: no range join and no row is multiplied.  ``tie`` orders rows of
    ``right`` with one time.
    """
    names = {v: f"_r_{v}" for v in values}
    l_ = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(n) for v, n in names.items()], F.lit(None).cast("int").alias("_is_right"))
    ties = [F.col(t).alias(f"_t_{t}") for t in tie]
    r_ = right.select(*by, ts, *[F.col(v).alias(n) for v, n in names.items()], F.lit(1).alias("_is_right"), *ties)
    both = l_.unionByName(r_, allowMissingColumns=True)
    side = F.col("_is_right").isNotNull().cast("int")
    # the frame ends at the current row: on equal times right rows come first unless strict
    turn = side.asc() if strict else side.desc()
    when = F.col(ts).desc() if forward else F.col(ts).asc()
    within = [F.col(f"_t_{t}").desc() if forward else F.col(f"_t_{t}").asc() for t in tie]
    w = W.partitionBy(*by).orderBy(when, turn, *within).rowsBetween(W.unboundedPreceding, 0)
    # one struct: values of one right row stay together even where some are null
    held = F.last(F.when(F.col("_is_right") == 1, F.struct(*names.values())), True).over(w)
    out = both.withColumn("_held", held).where(F.col("_is_right").isNull())
    return out.select(*[c for c in left.columns if c not in values], *[F.col(f"_held.{n}").alias(v) for v, n in names.items()])


def couple(fast: DataFrame, slow: DataFrame, values: Sequence[str], *, look_ahead: bool = True, **options: object) -> DataFrame:
    """Latest slow values on the fast clock; with ``look_ahead=False`` only those stamped before the fast bar."""
    return asof(fast, slow, values, strict=not look_ahead, **options)


def shared_clock(feeds: Mapping[str, DataFrame], value: str = "close", *, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One row whenever any feed advances, lagging feeds carried forward; a column a feed."""
    marked = [df.select(*by, ts, *[(F.col(value) if k == name else F.lit(None).cast(df.schema[value].dataType)).alias(k) for k in feeds]) for name, df in feeds.items()]
    all_ = marked[0]
    for df in marked[1:]:
        all_ = all_.unionByName(df)
    # feeds that advance together share a row
    rows = all_.groupBy(*by, ts).agg(*[F.max(k).alias(k) for k in feeds])
    return carried(rows.select(*by, ts, *feeds), list(feeds), by, ts)


def equal_times(left: DataFrame, right: DataFrame, *, on: Sequence[str] = ("ts",), suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Rows of both feeds that have the same stamp."""
    a = left.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in on])
    b = right.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in on])
    return a.join(b, list(on))


def benchmark_on(days: DataFrame, benchmark: DataFrame, *, day: str = "day", value: str = "ret") -> DataFrame:
    """The benchmark's value on the first of its days at or after each day; null past its end.

    Benchmarks are dated series of one row a day, so days are matched by an
    equi-join with the day that each calendar day maps to.  All days before the
    first of the benchmark map to that one, which is one row beside the others.
    """
    benchmark = benchmark.where(F.col(day).isNotNull())
    spans = benchmark.select(F.col(day).alias("_to"), F.col(value)).withColumn("_from", F.lag("_to").over(W.orderBy("_to")))
    mapped = spans.select(F.explode(F.sequence(F.coalesce(F.date_add("_from", 1), "_to"), "_to")).alias(day), F.col("_to").alias("benchmark_day"), value)
    first = benchmark.agg(F.min(F.struct(F.col(day).alias("day"), F.col(value).alias("value"))).alias("_first"))
    found = days.join(mapped, day, "left").crossJoin(F.broadcast(first))
    early = F.col(day) < F.col("_first.day")
    ends = {"benchmark_day": F.when(early, F.col("_first.day")).otherwise(F.col("benchmark_day")), value: F.when(early, F.col("_first.value")).otherwise(F.col(value))}
    return found.withColumns(ends).drop("_first")


def fills_with_orders(fills: DataFrame, orders: DataFrame, columns: Sequence[str] = ("sid",)) -> DataFrame:
    """Fills with columns of their order."""
    return fills.join(orders.select("order_id", *columns), "order_id")


def orphan_fills(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Fills of unknown orders: must be empty."""
    return fills.join(orders.select("order_id"), "order_id", "left_anti")


def first_bar_after(orders: DataFrame, bars: DataFrame, *, by: Sequence[str] = BY, created: str = "created_dt", ts: str = "ts") -> DataFrame:
    """The first bar of the order's series and day at or after its time (null if none), as ``bar_ts``."""
    asked = orders.withColumn(ts, F.col(created)).withColumn("_day", F.to_date(created))
    marks = bars.select(*by, ts, F.to_date(ts).alias("_day"), F.col(ts).alias("bar_ts"))
    return asof(asked, marks, ["bar_ts"], by=(*by, "_day"), ts=ts, forward=True).drop("_day", ts)


def enrich(df: DataFrame, instruments: DataFrame) -> DataFrame:
    """Instrument columns with a merger of "0" and a ratio of 0 where there is none.

    The dimension is small where Spark's size estimate says so; the planner
    decides between a broadcast and a shuffle.
    """
    out = df.join(instruments, "sid", "left")
    return out.withColumns({"merger": F.coalesce("merger", F.lit("0")), "ratio": F.coalesce(F.nanvl("ratio", F.lit(None).cast("double")), F.lit(0.0))})


def held_in(held: DataFrame, ranked: DataFrame, on: Sequence[str] = ("day", "sid")) -> DataFrame:
    """Held series that are in the ranking."""
    return held.join(ranked.select(*on), list(on), "left_semi")


def held_not_in(held: DataFrame, ranked: DataFrame, on: Sequence[str] = ("day", "sid")) -> DataFrame:
    """Held series that are not."""
    return held.join(ranked.select(*on), list(on), "left_anti")


def closed_series(yesterday: DataFrame, traded: DataFrame, held: DataFrame, on: Sequence[str] = ("sid",)) -> DataFrame:
    """(held yesterday or traded today) and not held now."""
    return yesterday.select(*on).union(traded.select(*on)).distinct().join(held.select(*on), list(on), "left_anti")
