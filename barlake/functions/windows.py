"""Window shorthands shared by all operators.

``by`` names the series (usually ``sid``), ``order`` the time and its
tie-breakers.  Frames are always given in rows: Spark's default frame with an
order is a RANGE, which would treat equal times as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BY, ORDER = ("sid",), ("ts",)


def series(by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> WindowSpec:
    """The series in time order, without a frame (for lag, lead, row_number)."""
    return W.partitionBy(*by).orderBy(*order)


def trailing(n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> WindowSpec:
    """The last ``n`` rows, the current one included."""
    return series(by, order).rowsBetween(-(n - 1), 0)


def expanding(by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> WindowSpec:
    """All rows up to the current one."""
    return series(by, order).rowsBetween(W.unboundedPreceding, 0)


def before(by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> WindowSpec:
    """All rows before the current one."""
    return series(by, order).rowsBetween(W.unboundedPreceding, -1)


def position(by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """1, 2, 3 ... within the series."""
    return F.row_number().over(series(by, order))


def warm(value: Column, min_period: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """``value`` from row ``min_period`` of the series on, null before."""
    return F.when(position(by, order) >= min_period, value)


def carried(df: DataFrame, columns: Sequence[str], by: Sequence[str], ts: str, stretch: int = 86_400) -> DataFrame:
    """``df`` with the last known value of each column in time order, per series or, with ``by=()``, overall.

    Without a series a window would be one task.  "The last known value" can be
    taken in two steps: within stretches of ``stretch`` seconds, and over the
    last values of the stretches, of which there is one row each.
    """
    if by:
        w = W.partitionBy(*by).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, True).over(w) for c in columns})
    rows = df.withColumn("_stretch", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (stretch * 1_000_000)))
    w = W.partitionBy("_stretch").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    known = rows.groupBy("_stretch").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_{c}") for c in columns])
    earlier = W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)  # one row a stretch
    before = known.select("_stretch", *[F.last(f"_{c}", True).over(earlier).alias(f"_{c}") for c in columns])
    out = rows.withColumns({c: F.last(c, True).over(w) for c in columns}).join(before, "_stretch")
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
