"""Orders against the bars of their day: sorted arrays and binary searches instead of orders times bars.

The bars of a series and day are a short list (a day has at most 1,440
minutes).  They meet the orders of that series and day in one task, as sorted
arrays with running sums and a table of minima over stretches of 1, 2, 4 ...
bars; each order then finds its first bar, the first bar that reaches its limit
or the bar that completes it by a binary search.  So an order costs the
logarithm of the day's bars, and no more rows leave than it has fills or slices.

Orders of one series and day are dealt out in parts of about ``ORDERS``, each
with a copy of the day's bars: a hot series is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Orders of a series and day that a task takes at once.
ORDERS = 100_000
_FIELDS = ("open", "high", "low", "close", "volume")


class Day:
    """The bars of a series and day as arrays in time order."""

    def __init__(self, bars: pa.Table):
        bars = bars.sort_by([("_us", "ascending")])
        self.table, self.us = bars, bars["_us"].to_numpy()
        self.n = len(self.us)

    def column(self, name: str) -> np.ndarray:
        """A column as doubles, NaN for null."""
        return self.table[name].to_numpy().astype(np.float64)

    def first_at_most(self, values: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Of each (start, limit) the first place from the start on whose value is at most the limit, n without one.

        Stretches whose minimum is above the limit are passed over, the longest
        first, so a search takes as many steps as the length has binary digits.
        """
        table = [np.where(np.isnan(values), np.inf, values)]
        while 2 ** len(table) <= self.n:
            half = 2 ** (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        at = starts.copy()
        limits = np.where(np.isnan(limits), -np.inf, limits)
        for k in reversed(range(len(table))):
            fits = at + 2**k <= self.n
            least = table[k][np.where(fits, at, 0)]
            at = np.where(fits & (least > limits), at + 2**k, at)
        # what is left is shorter than the last stretch passed over and was looked at down to single bars
        return at

    def starts(self, created: np.ndarray) -> np.ndarray:
        """The first bar at or after each time."""
        return np.searchsorted(self.us, created, side="left")


Met = Callable[[pa.Table, Day], tuple[np.ndarray, dict[str, np.ndarray | pa.Array]]]


def against_days(orders: DataFrame, bars: DataFrame, met: Met, columns: Sequence[tuple[str, T.DataType]], *, by: Sequence[str], created: str, ts: str, fields: Sequence[str] = _FIELDS) -> DataFrame:
    """(the orders' columns, columns): what ``met`` makes of the orders of each series and day and its bars.

    ``met`` takes the orders (with ``_us``, their time) and the ``Day`` and gives
    the places of the orders that its rows belong to, and the new columns.
    Orders without a time, and days without orders or bars, give no rows.
    """
    day, fields = F.to_date(created), [c for c in fields if c in bars.columns]
    asked = orders.withColumns({"_day": day, "_us": F.unix_micros(F.col(created).cast("timestamp"))}).where("_us is not null")
    sizes = asked.groupBy(*by, "_day").agg(F.ceil(F.count("*") / ORDERS).cast("int").alias("_parts"))
    book = bars.select(*by, F.to_date(ts).alias("_day"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(ts).alias("_ts"), *fields).where("_us is not null")
    book = book.join(sizes, [*by, "_day"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    wide = sizes.where("_parts > 1")
    dealt = asked.join(wide, [*by, "_day"], "left")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(*orders.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    names, new = list(orders.columns), [name for name, _ in columns]

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if len(mine) and len(theirs):
            at, made = met(mine, Day(theirs))
        else:
            at, made = np.zeros(0, np.int64), {name: pa.nulls(0, kind) for name, kind in zip(new, arrow, strict=True)}
        kept = mine.select(names).take(pa.array(at, pa.int64()))
        values = [made[c] if isinstance(made[c], (pa.Array, pa.ChunkedArray)) else pa.array(made[c]) for c in new]
        return pa.table([*kept.columns, *[v.cast(kind) for v, kind in zip(values, arrow, strict=True)]], [*names, *new])

    schema = T.StructType([*orders.schema, *[T.StructField(name, kind) for name, kind in columns]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = [f.type for f in to_arrow_schema(T.StructType([T.StructField(name, kind) for name, kind in columns]), timestamp_utc=True)]
    keys = [*by, "_day", "_part"]
    return dealt.groupBy(*keys).cogroup(book.groupBy(*keys)).applyInArrow(meet, schema)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [start, end) one after another: which range each place belongs to, and the place."""
    size = np.maximum(ends - starts, 0)
    owner = np.repeat(np.arange(len(size)), size)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    return owner, np.arange(len(owner)) - first[owner] + starts[owner]
