"""Crossings of two lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import num
from ..functions.windows import BY, ORDER, expanding, series


def nonzero_difference(a: Column, b: Column, *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """a - b, or the last difference that was not zero (0 before any)."""
    d = a - b
    return F.when(d.isNotNull(), F.coalesce(F.last(F.nullif(d, F.lit(0.0)), True).over(expanding(by, order)), F.lit(0.0)))


def _crossed(df: DataFrame, a: str, b: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    nzd = nonzero_difference(F.col(a), F.col(b), by=by, order=order)
    return df.withColumn("_nzd", nzd).withColumn("_was", F.lag("_nzd").over(series(by, order)))


def _up(a: str, b: str) -> Column:
    return num(F.coalesce((F.col("_was") < 0) & (F.col(a) > F.col(b)), F.lit(False)))


def _down(a: str, b: str) -> Column:
    return num(F.coalesce((F.col("_was") > 0) & (F.col(a) < F.col(b)), F.lit(False)))


def cross_up(df: DataFrame, a: str, b: str, name: str = "cross_up", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    return _crossed(df, a, b, by, order).withColumn(name, _up(a, b)).drop("_nzd", "_was")


def cross_down(df: DataFrame, a: str, b: str, name: str = "cross_down", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    return _crossed(df, a, b, by, order).withColumn(name, _down(a, b)).drop("_nzd", "_was")


def crossover(df: DataFrame, a: str, b: str, name: str = "crossover", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """1 where a crosses above b, -1 below, else 0."""
    return _crossed(df, a, b, by, order).withColumn(name, _up(a, b) - _down(a, b)).drop("_nzd", "_was")
