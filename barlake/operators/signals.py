"""Signals: combination by type, position state, stops, parameter grids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import BY, ORDER, before, expanding, series
from .cross import cross_down, cross_up
from .recursive import ema, macd, rsi
from .rolling import highest, lowest, sma
from .spans import SpanStop, in_spans
from .steps import ArmedStop
from .stepwise import stepwise


def _all(columns: Sequence[str], test: Callable[[Column], Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(test(F.col(c)), F.lit(False)) for c in columns]) if columns else F.lit(False)


def _any(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != 0, F.lit(False)) for c in columns]) if columns else F.lit(False)


def _entered(signals: Mapping[str, Sequence[str]], side: str) -> Column:
    """A side's plain signals all have its sign, or its inverted ones all the other, or any of its ANY ones is not 0."""
    up, down = (lambda c: c > 0), (lambda c: c < 0)
    plain, inverted = (down, up) if side.startswith("SHORT") else (up, down)
    return _all(signals.get(side, ()), plain) | _all(signals.get(f"{side}_INV", ()), inverted) | _any(signals.get(f"{side}_ANY", ()))


def combine(df: DataFrame, signals: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds booleans enter_long, enter_short, exit_long, exit_short, leave_long and leave_short.

    ``signals`` maps types (LONG, LONG_INV, LONG_ANY, SHORT..., LONGEXIT...,
    SHORTEXIT...) to columns.  An opposite entry exits if no explicit exit
    signal exists; a side is left when its own plain signals weaken to the other sign.
    """
    long_, short = _entered(signals, "LONG"), _entered(signals, "SHORT")

    def leaves(side: str, other: Column, weak: Callable[[Column], Column]) -> tuple[Column, Column]:
        explicit = any(k.startswith(f"{side}EXIT") for k in signals)
        out = _entered_exit(signals, side) if explicit else other
        return out, F.lit(False) if explicit else _all(signals.get(side, ()), weak)

    exit_long, leave_long = leaves("LONG", short, lambda c: c < 0)
    exit_short, leave_short = leaves("SHORT", long_, lambda c: c > 0)
    return df.withColumns({"enter_long": long_, "enter_short": short, "exit_long": exit_long, "exit_short": exit_short, "leave_long": leave_long, "leave_short": leave_short})


def _entered_exit(signals: Mapping[str, Sequence[str]], side: str) -> Column:
    """Exit types: a long exits on signals below 0, a short on signals above 0."""
    name = f"{side}EXIT"
    up, down = (lambda c: c > 0), (lambda c: c < 0)
    plain, inverted = (down, up) if side == "LONG" else (up, down)
    return _all(signals.get(name, ()), plain) | _all(signals.get(f"{name}_INV", ()), inverted) | _any(signals.get(f"{name}_ANY", ()))


def position_state(df: DataFrame, enter: Column, leave: Column, name: str = "position", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """1 from an entry on, 0 from an exit on, 0 before any."""
    event = F.when(enter, 1).when(leave, 0)
    return df.withColumn("_e", event).withColumn(name, F.coalesce(F.last("_e", True).over(expanding(by, order)), F.lit(0))).drop("_e")


def entries(df: DataFrame, enter: Column, leave: Column, accumulate: bool = False, name: str = "entry", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Whether a bar's entry acts: always if ``accumulate``, else only while out of the market."""
    rows = df.withColumn("_e", F.when(enter, 1).when(leave, 0))
    was = F.coalesce(F.last("_e", True).over(before(by, order)), F.lit(0))
    acts = F.coalesce(F.col("_e") == 1, F.lit(False)) & (F.lit(accumulate) | (was == 0))
    return rows.withColumn(name, acts).drop("_e")


# --- signal library ----------------------------------------------------------


def low_band_ratio(df: DataFrame, n: int = 120, name: str = "low_band", **key: Sequence[str]) -> DataFrame:
    """close / lowest(n) - 2."""
    return lowest(df, n, "close", "_x", **key).withColumn(name, F.try_divide(F.col("close"), F.col("_x")) - 2).drop("_x")


def high_band_ratio(df: DataFrame, n: int = 120, threshold: float = 0.8, name: str = "high_band", **key: Sequence[str]) -> DataFrame:
    """close / (highest(n) threshold) - 1."""
    return highest(df, n, "close", "_x", **key).withColumn(name, F.try_divide(F.col("close"), F.col("_x") * threshold) - 1).drop("_x")


def volume_ratio(df: DataFrame, n: int = 5, threshold: float = 2.0, name: str = "volume_ratio", **key: Sequence[str]) -> DataFrame:
    """sma(volume) / (volume threshold) - 1."""
    return sma(df, n, "volume", "_x", **key).withColumn(name, F.try_divide(F.col("_x"), F.col("volume") * threshold) - 1).drop("_x")


def sma_ratio(df: DataFrame, n: int = 20, name: str = "sma_ratio", **key: Sequence[str]) -> DataFrame:
    """close / sma(n) - 1 (on bars of any frame, such as weeks)."""
    return sma(df, n, "close", "_x", **key).withColumn(name, F.try_divide(F.col("close"), F.col("_x")) - 1).drop("_x")


def macd_signal(df: DataFrame, name: str = "macd_histo", **key: Sequence[str]) -> DataFrame:
    out = macd(df, **key)
    return out if name == "macd_histo" else out.withColumnRenamed("macd_histo", name)


def drawdown_budget(df: DataFrame, threshold: float = 0.2, x: str = "close", name: str = "drawdown_budget", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """threshold less the largest drawdown so far."""
    w = expanding(by, order)
    rows = df.withColumn("_dd", 1 - F.try_divide(F.col(x), F.max(x).over(w)))
    return rows.withColumn(name, threshold - F.max("_dd").over(w)).drop("_dd")


def price_less_sma(df: DataFrame, n: int = 30, x: str = "close", name: str = "price_less_sma", **key: Sequence[str]) -> DataFrame:
    return sma(df, n, x, "_x", **key).withColumn(name, F.col(x) - F.col("_x")).drop("_x")


def sma_spread(df: DataFrame, fast: int = 10, slow: int = 30, x: str = "close", name: str = "sma_spread", **key: Sequence[str]) -> DataFrame:
    return sma(sma(df, fast, x, "_f", **key), slow, x, "_s", **key).withColumn(name, F.col("_f") - F.col("_s")).drop("_f", "_s")


def rsi_band(df: DataFrame, n: int = 14, low: float = 30.0, middle: float = 50.0, high: float = 70.0, **key: Sequence[str]) -> DataFrame:
    """Adds rsi, long (crosses up over low), long_exit (above the middle), short (crosses down under high), short_exit."""
    rows = rsi(df, n, **key).withColumns({"_lo": F.lit(low), "_hi": F.lit(high)})
    rows = cross_down(cross_up(rows, "rsi", "_lo", "long", **key), "rsi", "_hi", "short", **key).drop("_lo", "_hi")
    return rows.withColumns({"long_exit": F.coalesce((F.col("rsi") > middle).cast("double"), F.lit(0.0)), "short_exit": F.coalesce((F.col("rsi") < middle).cast("double"), F.lit(0.0))})


def new_high(df: DataFrame, n: int = 20, name: str = "new_high", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Whether a bar's high is the highest of the last n."""
    return highest(df, n, "high", "_x", by=by, order=order).withColumn(name, F.coalesce((F.col("high") == F.col("_x")).cast("double"), F.lit(0.0))).drop("_x")


def trailing_stop(df: DataFrame, enter: str, distance: str, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds stop and stopped for entries that start a run of their own.

    From each entry the stop is the highest close - distance so far; a close
    below it stops the run out.  An entry always starts a new run.
    """
    group = F.sum(F.when(F.col(enter), 1).otherwise(0)).over(expanding(by, order))
    rows = df.withColumn("_g", group)
    run = (*by, "_g")
    level = F.max(F.col("close") - F.col(distance)).over(expanding(run, order))
    rows = rows.withColumn("_level", F.when(F.col("_g") > 0, level))
    was = F.lag("_level").over(series(run, order))
    rows = rows.withColumn("_hit", F.coalesce((F.col("close") < was).cast("int"), F.lit(0)))
    first = F.sum("_hit").over(expanding(run, order))
    rows = rows.withColumn("_hits", first)
    gone = F.coalesce(F.lag("_hits").over(series(run, order)), F.lit(0)) > 0
    return rows.withColumns({"stop": F.when(~gone, F.col("_level")), "stopped": (F.col("_hit") == 1) & ~gone}).drop("_g", "_level", "_hit", "_hits")


def trailing_stop_positions(df: DataFrame, enter: str, distance: str, *, tie: Sequence[str], by: Sequence[str] = BY, ts: str = "ts", width: int | None = None) -> DataFrame:
    """Positions where an entry acts only while flat and a stop re-arms it: each step needs the last one.

    Rows of one time are taken in the order of ``tie``, whose columns stay in the
    result; it is empty where a series has one row a time.  With ``width``
    (seconds, ``spans``) a series is spread over tasks.
    """
    if width is not None:
        return in_spans(df, lambda: SpanStop(enter, distance), by=by, ts=ts, tie=tie, width=width)
    return stepwise(df, lambda: ArmedStop(enter, distance), by=by, ts=ts, tie=tie)


def parameter_grid(df: DataFrame, grid: Mapping[str, Sequence[object]]) -> DataFrame:
    """Every row once for each combination of parameter values; ``param_id`` joins the series' key.

    The grid is a literal of the plan (an exploded array), not a joined table.
    """
    names = list(grid)
    combos = [dict(zip(names, values, strict=True)) for values in product(*grid.values())]
    structs = [F.struct(F.lit(i).alias("param_id"), *[F.lit(c[n]).alias(n) for n in names]) for i, c in enumerate(combos)]
    return df.select("*", F.explode(F.array(*structs)).alias("_p")).select(*df.columns, "_p.*")


def ema_cross_position(df: DataFrame, fast: int, slow: int, **key: Sequence[str]) -> DataFrame:
    """Position of a crossing of two exponential averages."""
    rows = ema(ema(df, fast, "close", "_f", **key), slow, "close", "_s", **key)
    rows = cross_down(cross_up(rows, "_f", "_s", "_u", **key), "_f", "_s", "_d", **key)
    return position_state(rows, F.col("_u") == 1, F.col("_d") == 1, **key).drop("_f", "_s", "_u", "_d")
