"""Dense places 0, 1, 2 ... of rows in a total order, without one window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored


def placed(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df``, stored in range partitions of ``order``, with each row's place in it.

    A range partition is sorted by its own task; a row's place is its number
    there plus the rows of the partitions before, of which there is one count a
    partition.  The numbers are written with the rows, so a repeated task or a
    second reader sees the same ones.  Rows equal in ``order`` get places beside
    each other, in no defined order; if many rows are equal in all of it, one
    task sorts them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("_number", F.monotonically_increasing_id()), name)
    part = F.shiftright("_number", 33)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    out = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")  # 16 bytes a partition
    return out.withColumn(name, F.col("_start") + F.col("_number").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_number")
