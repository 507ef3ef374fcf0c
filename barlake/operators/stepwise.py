"""Step machines over tables: one Python step a row, in bounded memory."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import Make


def _sorted(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, ts, *tie)


def _plain(column: pa.Array) -> list:
    """A column's Python values; numbers and flags are converted at once, text once for each different value."""
    kind, nulls = column.type, column.null_count
    if nulls == len(column):
        return [None] * nulls
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        coded = column.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        return [None if i is None else texts[i] for i in _plain(coded.indices)]
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    if not nulls:
        return column.to_numpy(zero_copy_only=False).tolist()
    values = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def _given(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    """The named columns' values, row by row."""
    return zip(*[_plain(batch.column(c)) for c in names], strict=True) if names else repeat((), batch.num_rows)


def stepwise(df: DataFrame, make: Make, *, by: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """(by, ts, tie, columns): rows of each series in order through a machine of its own.

    Rows of one time are taken in the order of ``tie``, nulls first; it should
    be total, or rows equal in it come in no defined order.  Rows arrive sorted
    in Arrow batches and only the machine's state is carried, so a series of
    any length takes the memory of one batch; series are the unit of
    parallelism.  A machine gets its ``inputs``; the other columns stay in Arrow.
    """
    named = make()
    new = [(name, kind) for name, (kind, _) in named.columns]
    kinds = [kind for _, (_, kind) in named.columns]
    keep = [*by, ts, *[c for c in tie if c not in dict(new)]]
    inputs = list(dict.fromkeys(named.inputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, step = None, None
        for batch in batches:
            kept, values = [], []
            for i, (own, row) in enumerate(zip(_given(batch, by), _given(batch, inputs), strict=True)):
                if own != series:
                    series, step = own, make()
                out = step(dict(zip(inputs, row, strict=True)))
                kept += [i] * len(out)
                values += out
            same = batch.select(keep).take(pa.array(kept, pa.int64()))
            made = [pa.array(v, kind) for v, kind in zip(zip(*values, strict=True) if values else repeat(()), kinds)]  # noqa: B905
            yield pa.RecordBatch.from_arrays([*same.columns, *made], [*keep, *[name for name, _ in new]])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for name, kind in new])
    needed = dict.fromkeys([*by, ts, *tie, *named.inputs])
    return _sorted(df.select(*needed), by, ts, tie).mapInArrow(run, schema)


def final_states(df: DataFrame, make: Make, *, by: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """(by, state, last_ts, last_tie): what the machine of each series holds after its last row, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, step, last = None, None, None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                own = (tuple(row[k] for k in by),)
                if own != series:
                    if series is not None:
                        done.append((*series[0], json.dumps(step.state), *last))
                    series, step = own, make()
                step(row)
                last = row[ts], json.dumps([row[c] for c in tie], default=str)
            if len(done) > 1000:
                yield _rows(done)
                done = []
        if series is not None:
            done.append((*series[0], json.dumps(step.state), *last))
        if done:
            yield _rows(done)

    names = [*by, "state", "last_ts", "last_tie"]
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("state", T.StringType()), T.StructField("last_ts", df.schema[ts].dataType), T.StructField("last_tie", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema, timestamp_utc=True)

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], arrow.field(j).type) for j in range(len(names))], names)

    needed = dict.fromkeys([*by, ts, *tie, *make().inputs])
    return _sorted(df.select(*needed).where(F.col(ts).isNotNull()), by, ts, tie).mapInArrow(run, schema)
