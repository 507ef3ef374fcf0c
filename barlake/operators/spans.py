"""Step machines over hot series: what a span of rows makes of any state it may begin in.

A machine's next step needs its last one, so a series would be one task's work.
But what a span does to *every* possible state can be worked out without
knowing the one it begins in, since most states soon meet: a band far from the
price moves one rung a row until it is in reach, and all trailing stops that
are hit by the same row go on alike.  So the spans of a series are summed up in
parallel, a pass over the small summaries finds the state in which each span
begins, and then the spans run in parallel from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import ArmedStop, Renko, Step, known, nearest
from .stretches import SECONDS, numbered

#: Rows of a span.
ROWS = 1024


class SpanStep(Step):
    """A machine that can sum up a span: ``summary`` gives plain values, ``leap`` takes the state over the span."""

    def summary(self, rows: list[dict]) -> object:
        raise NotImplementedError

    def leap(self, summary: object) -> None:
        raise NotImplementedError


class SpanStop(ArmedStop, SpanStep):
    """Of a stop that is set when the span begins only the first close below it, or below the stops that the span itself sets, matters."""

    def _flat_from(self, rows: list[dict], at: int) -> list:
        step = ArmedStop(self.enter, self.distance)
        for row in rows[at:]:
            step(row)
        return step.state

    def summary(self, rows: list[dict]) -> object:
        cuts, least, raised, ended = [], None, None, None
        for i, row in enumerate(rows):
            close, gap = row["close"], row[self.distance]
            if not known(close):
                continue
            if raised is not None and close < raised:  # hits any stop, however low it began
                ended = self._flat_from(rows, i + 1)
                if least is None or close < least:
                    cuts.append([close, ended])
                break
            if least is None or close < least:
                least = close
                cuts.append([close, self._flat_from(rows, i + 1)])
            if known(gap):
                raised = close - gap if raised is None else max(raised, close - gap)
        return [self._flat_from(rows, 0), cuts, ended, raised]

    def leap(self, summary: object) -> None:
        flat, cuts, ended, raised = summary
        (stop,) = self.state
        if stop is None:
            self.state = flat
            return
        hit = next((end for close, end in cuts if close < stop), ended)
        self.state = hit if hit is not None else [stop if raised is None else max(stop, raised)]


class SpanRenko(Renko, SpanStep):
    """Bands are rungs of one ladder, so a span maps rung to rung; beyond the reach of its prices rungs move a step a row."""

    inputs = (*Renko.inputs, "_open")

    def _ladder(self, open_: float) -> tuple[float, float]:
        origin = nearest(open_ / self.align) * self.align
        height = self.size or float(origin // self.autosize)
        return int(origin) if self.round_start else origin, height

    def _run(self, rows: list[dict], state: list) -> list:
        step = Renko(self.size, self.autosize, self.align, self.hilo, False, self.round_start)
        step.state = state
        for row in rows:
            step(row)
        return step.state

    def summary(self, rows: list[dict]) -> object:
        rows = [r for r in rows if known(r["close"])]
        begun = next((r["_open"] for r in rows if known(r["_open"])), None)
        if begun is None:
            return None
        origin, height = self._ladder(begun)
        ups, downs = (np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in (("high", "low") if self.hilo else ("close", "close")))
        reach = [x for x in ((ups - origin) / height, (downs - origin) / height)]
        low, high = int(np.nanmin(np.floor(reach))) - 2 - len(rows), int(np.nanmax(np.ceil(reach))) + 2 + len(rows)
        begin = np.arange(low, high + 1)
        state, back = begin, np.arange(len(begin))
        for up, down in zip(ups.tolist(), downs.tolist(), strict=True):
            rises = up >= origin + (state + 1) * height
            state = state + rises - (~rises & (down <= origin + state * height))
            if len(state) > 64:
                state, to = np.unique(state, return_inverse=True)  # rungs that have met go on as one
                back = to[back]
        wide = self._run(rows, [origin - height, origin + height, height])
        return [begun, low, len(rows), state[back].tolist(), wide, self._run(rows, [None, None, None])]

    def leap(self, summary: object) -> None:
        if summary is None:
            return
        begun, first, steps, rungs, wide, fresh = summary
        low, high, height = self.state
        if low is None:
            self.state = fresh
            return
        origin, height = self._ladder(begun)
        if high - low > 1.5 * height:
            self.state = wide
            return
        k = round((low - origin) / height)
        at = k - first
        k = rungs[at] if 0 <= at < len(rungs) else k + steps if at < 0 else k - steps
        self.state = [origin + k * height, origin + (k + 1) * height, height]


def in_spans(df: DataFrame, make: Callable[[], SpanStep], *, by: Sequence[str], ts: str, tie: Sequence[str], rows: int = ROWS, width: int = SECONDS) -> DataFrame:
    """What ``stepwise`` gives, with every series cut into spans of ``rows`` rows that run on any task.

    Rows are numbered in stretches of ``width`` seconds (``stretches``), so
    ``ts`` and ``tie`` should be a total order.  One task reads a series'
    summaries in order, a few values for ``rows`` rows.
    """
    named = make()
    new = [(name, kind) for name, (kind, _) in named.columns]
    kinds = [kind for _, (_, kind) in named.columns]
    keep = [*by, ts, *[c for c in tie if c not in dict(new)]]
    needed = dict.fromkeys([*by, ts, *tie, *named.inputs])
    counted = numbered(df.select(*needed), "_n", by=by, order=(ts, *tie), width=width)
    spans = counted.withColumn("_span", F.floor((F.col("_n") - 1) / rows))
    keys = [*by, "_span"]

    def sum_up(table: pa.Table) -> pa.Table:
        step, table = make(), table.sort_by("_n")
        said = json.dumps(step.summary(table.select(list(named.inputs)).to_pylist()))
        return pa.table([*[table[c].slice(0, 1) for c in keys], pa.array([said])], [*keys, "_summary"])

    key_fields = [spans.schema[c] for c in keys]
    summaries = spans.groupBy(*keys).applyInArrow(sum_up, T.StructType([*key_fields, T.StructField("_summary", T.StringType())]))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, step = None, None
        for batch in batches:
            states = []
            for row in batch.to_pylist():
                own = (tuple(row[k] for k in by),)
                if own != series:
                    series, step = own, make()
                states.append(json.dumps(step.state))
                step.leap(json.loads(row["_summary"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(states, pa.string())], [*keys, "_state"])

    states = summaries.repartition(*by).sortWithinPartitions(*keys).mapInArrow(begin, T.StructType([*key_fields, T.StructField("_state", T.StringType())]))

    def run(table: pa.Table, state: pa.Table) -> pa.Table:
        step, table = make(), table.sort_by("_n")
        kept, values = [], []
        if len(state) and len(table):
            step.state = json.loads(state["_state"][0].as_py())
            for i, row in enumerate(table.select(list(named.inputs)).to_pylist()):
                out = step(row)
                kept += [i] * len(out)
                values += out
        same = table.select(keep).take(pa.array(kept, pa.int64()))
        return pa.table([*same.columns, *[pa.array([v[j] for v in values], kind) for j, kind in enumerate(kinds)]], [*keep, *[name for name, _ in new]])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for name, kind in new])
    return spans.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInArrow(run, schema)
