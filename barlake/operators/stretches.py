"""Hot series: windows, row numbers and running values of one series over many tasks.

The plain operators give a series to one task.  Where one series holds a large
part of all rows, these forms cut it: into stretches of time, whose totals (a
row each) are carried forward, or into stretches of rows, each with copies of
the few rows before it that its windows look back at.  Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import BY, ORDER, expanding

#: Seconds (or units of a numeric order) of a stretch of time, rows of a stretch of rows.
SECONDS, ROWS = 86_400, 1 << 16
_KINDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _stretch(df: DataFrame, ts: str, width: int) -> Column:
    if isinstance(df.schema[ts].dataType, T.NumericType):
        return F.floor(F.col(ts) / width)
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (width * 1_000_000))


def running(df: DataFrame, values: Mapping[str, tuple[str, Column]], *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: int = SECONDS) -> DataFrame:
    """``df`` with running values of each series, the current row included.

    ``values`` names them: (kind, input), with the kinds sum, count, min, max,
    first and last (known value).  Each is taken inside stretches of ``width``
    of ``order[0]``, and over the totals of the stretches before; a series of
    any size costs a task one stretch.  Rows without time are a stretch of their
    own, the first.
    """
    inputs = {f"_v_{name}": value for name, (_, value) in values.items()}
    rows = df.withColumns({"_stretch": _stretch(df, order[0], width), **inputs})
    inside, keys = expanding((*by, "_stretch"), order), [*by, "_stretch"]
    place = F.struct(*[F.col(c) for c in order])
    totals, locals_, carries, out = [], {}, {}, {}
    earlier = W.partitionBy(*by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)  # one row a stretch
    for name, (kind, _) in values.items():
        v, total = F.col(f"_v_{name}"), f"_t_{name}"
        here, past = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in _KINDS:
            f = _KINDS[kind]
            totals.append(f(v).alias(total))
            locals_[f"_l_{name}"] = f(v).over(inside)
            carries[f"_c_{name}"] = (F.sum if kind == "count" else f)(total).over(earlier)
            if kind in ("sum", "count"):
                out[name] = F.when(here.isNull(), past).when(past.isNull(), here).otherwise(past + here)
            else:
                out[name] = (F.least if kind == "min" else F.greatest)(past, here)
        elif kind in ("first", "last"):
            at = F.when(v.isNotNull(), place)
            pick, over = (F.min_by, F.first) if kind == "first" else (F.max_by, F.last)
            totals.append(pick(v, at).alias(total))
            locals_[f"_l_{name}"] = over(v, True).over(inside)
            carries[f"_c_{name}"] = over(total, True).over(earlier)
            out[name] = F.coalesce(past, here) if kind == "first" else F.coalesce(here, past)
        else:
            raise ValueError(f"no such running value: {kind}")
    before = rows.groupBy(*keys).agg(*totals).select(*keys, *[c.alias(name) for name, c in carries.items()])
    before = before.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *carries)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = rows.withColumns(locals_).join(before, same)
    return joined.select(*[c for c in df.columns if c not in out], *[c.alias(name) for name, c in out.items()])


def numbered(df: DataFrame, name: str = "n", *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: int = SECONDS) -> DataFrame:
    """``df`` with 1, 2, 3 ... within each series, as ``position`` gives; ``order`` should be total."""
    return running(df, {name: ("count", F.lit(1))}, by=by, order=order, width=width)


def in_stretches(df: DataFrame, back: int, f: Callable[[DataFrame, Sequence[str]], DataFrame], *, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: int = SECONDS, rows: int = ROWS) -> DataFrame:
    """``f(df, by)`` for an operator that looks back at most ``back`` rows, with each series cut into stretches.

    A stretch holds ``rows`` rows of a series and copies of the ``back`` rows
    before it; ``f`` gets them with a series key that tells stretches apart, and
    what it makes of the copies is dropped.  Warm-ups come out right: a stretch
    that isn't the first has all that its first row looks back at.
    """
    if not 0 <= back <= rows:
        raise ValueError(f"an operator that looks back {back} rows needs stretches of at least as many")
    counted = numbered(df, "_n", by=by, order=order, width=width)
    own = F.floor((F.col("_n") - 1) / rows)
    copies = F.when((F.col("_n") - 1) % rows >= rows - back, F.array(own, own + 1)).otherwise(F.array(own))
    spread = counted.withColumn("_part", F.explode(copies)).withColumn("_copy", F.col("_part") != own).drop("_n")
    return f(spread, (*by, "_part")).where(~F.col("_copy")).drop("_part", "_copy")


