"""Structured Streaming forms: live bars, late rows, sessions, per-series state, sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.buckets import bucket_end, period_key
from ..functions.windows import BY
from ..operators.resample import bar_aggregates
from ..operators.steps import Average, Kaufman, Make, Renko
from ..operators.stepwise import final_states
from ..operators.stretches import running
from ..sources.schema import FIELDS
from ..sources.upserts import PARTS, UpsertTable

DELAY = "1 hour"
#: Rows that wait for the watermark lie in blocks of one such slot of time (microseconds), cut from so many rows as they arrive.
SLOT_US, HELD_ROWS = 21_600_000_000, 1 << 18


def stream_ticks(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive; a TIMESTAMP_NTZ ``ts`` is cast, as watermarks need TIMESTAMP."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def live_bars(ticks: DataFrame, unit: str = "minutes", compression: int = 1, delay: str = DELAY, *, by: Sequence[str] = BY, tie: Sequence[str] = ()) -> DataFrame:
    """Bars (start, end] of a stream of bars or ticks; a bar is out when the watermark passes its end."""
    end = F.date_add(period_key(F.col("ts"), "days"), 1).cast("timestamp") if unit == "days" else bucket_end(F.col("ts"), unit, compression)
    marked = ticks.withColumn("bar_ts", end).withWatermark("bar_ts", delay)
    return marked.groupBy(*by, "bar_ts").agg(*bar_aggregates("ts", tie)).select(*by, F.col("bar_ts").alias("ts"), *FIELDS)


def drop_duplicates(ticks: DataFrame, delay: str = DELAY, keys: Sequence[str] = ("sid", "ts")) -> DataFrame:
    """The first arrival of each (sid, ts) within the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def late_rows(batch: DataFrame, delivered: DataFrame, *, by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Rows of a table that are not older, and those that are older, than what their series has delivered (by, last_ts)."""
    marked = batch.join(delivered, list(by), "left")
    on_time = F.col("last_ts").isNull() | (F.col("ts") >= F.col("last_ts"))
    return marked.where(on_time).drop("last_ts"), marked.where(~on_time).drop("last_ts")


def backfill_then_live(history: DataFrame, live: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """History, and of the live rows (a table) those after its end."""
    last = history.groupBy(*by).agg(F.max("ts").alias("last_ts"))
    after = live.join(last, list(by), "left").where(F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts")))
    return history.unionByName(after.select(*history.columns))


def mark_late(stream: DataFrame, delivered: DataFrame | None = None, *, by: Sequence[str] = BY, ts: str = "ts", arrival: Sequence[str] = ()) -> DataFrame:
    """The rows of a stream with ``late``: whether their series has delivered a newer row before.

    Each series keeps the newest time it has delivered as state, so the mark
    advances with every micro-batch; ``delivered`` (by, last_ts) seeds it.  Late
    rows don't move it, rows of the same time are not late.  The rows of a
    micro-batch count as arriving in the order of ``arrival``, by default in
    time order, so that none is late because of another of its batch; with
    ``arrival`` a task holds the rows of one series and micro-batch.  Rows
    without time are on time and leave the mark.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names = stream.columns
    order = list(arrival)

    class Mark(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "us long")

        def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
            times = initialState["last_ts"].dropna()
            if len(times):
                self.last.update((int(times.max().value // 1000),))

        def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
            import numpy as np
            import pandas as pd

            least = np.iinfo(np.int64).min
            end = last = self.last.get()[0] if self.last.exists() else least
            for batch in [pd.concat(list(rows)).sort_values(order, kind="stable", na_position="first")] if order else rows:
                us = np.where(batch[ts].isna(), least, batch[ts].astype("datetime64[us]").astype("int64"))
                # in time order only rows before the micro-batch make one late
                newest = np.maximum.accumulate(np.concatenate([[last], us])) if order else np.full(len(us) + 1, last)
                end = max(end, int(us.max(initial=least)))
                yield batch.assign(late=(us < newest[:-1]) & (us > least))[[*names, "late"]]
            if end > least:
                self.last.update((int(end),))

        def close(self) -> None:
            pass

    schema = T.StructType([*stream.schema, T.StructField("late", T.BooleanType())])
    seed = None if delivered is None else delivered.select(*by, "last_ts").groupBy(*by)
    return stream.groupBy(*by).transformWithStateInPandas(Mark(), outputStructType=schema, outputMode="Append", timeMode="None", initialState=seed)


def inactivity_sessions(ticks: DataFrame, gap: str = "12 hours", delay: str = DELAY, *, by: Sequence[str] = BY) -> DataFrame:
    """Rows and first and last times of sessions that a gap ends."""
    grouped = ticks.withWatermark("ts", delay).groupBy(*by, F.session_window("ts", gap).alias("_w"))
    return grouped.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("_w")


def live_steps(
    rows: DataFrame, make: Make, *, by: Sequence[str] = BY, ts: str = "ts", tie: Sequence[str] = (), delay: str = DELAY, history: DataFrame | None = None, idle: int | None = None,
) -> DataFrame:
    """(by, ts, tie, the machine's columns) of a stream, one machine of ``operators.steps`` a series.

    Rows wait in the state, in blocks by time, until the watermark has passed
    them, and are then taken in time order, rows of one time in the order of
    ``tie`` (nulls first) and then of arrival; a task holds the rows of one slot
    of time.  With ``history``, a table of earlier rows, each
    series' machine begins where its history ended, and rows up to that point
    (in time and tie) are passed over: history through ``stepwise`` and the
    stream together are what ``stepwise`` gives for all rows.  A series without
    rows for ``idle`` seconds (of event time) is forgotten and begins anew.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    machine = make()
    inputs = list(dict.fromkeys([*machine.inputs, *tie]))
    # a block holds rows of one slot of time: when (microseconds), the place in arrival, inputs
    held = to_arrow_schema(T.StructType([T.StructField("at", T.LongType()), T.StructField("arrival", T.LongType()), *[T.StructField(f"c{i}", rows.schema[c].dataType) for i, c in enumerate(inputs)]]))
    ties = [inputs.index(c) for c in tie]
    order = [("at", "ascending"), *[(f"c{i}", "ascending") for i in ties], ("arrival", "ascending")]
    columns = [*by, ts, *tie, *[name for name, _ in machine.columns if name not in tie]]
    picked = [j for j, (name, _) in enumerate(machine.columns) if name not in tie]

    def rank(values: Sequence) -> list:
        return [(x is not None, x) for x in values]

    def packed(table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    class Steps(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("machine", "state string, last long, tie string, released long")
            self.arrived = handle.getValueState("arrived", "n long")
            self.next = handle.getValueState("next", "ms long")
            self.waiting = handle.getMapState("waiting", "slot long, part long", "rows binary")

        def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
            for state, last, ended in zip(initialState["state"], initialState["last_ts"], initialState["last_tie"], strict=True):
                self.state.update((state, int(last.value // 1000), ended, -1))
                if idle is not None:
                    self.handle.registerTimer(int(last.value // 1_000_000) + idle * 1000 + 1)

        def wait(self, table: pa.Table) -> None:
            """Puts rows away, a block a slot; the key's one timer stands at its first row."""
            import numpy as np

            us = table["at"].to_numpy()
            by_slot = np.argsort(us // SLOT_US, kind="stable")
            slots, starts = np.unique((us // SLOT_US)[by_slot], return_index=True)
            table, arrival = table.take(pa.array(by_slot)), table["arrival"].to_numpy()[by_slot]
            for slot, low, high in zip(slots.tolist(), starts.tolist(), [*starts[1:].tolist(), len(us)], strict=True):
                self.waiting.updateValue((slot, int(arrival[low])), (packed(table.slice(low, high - low)),))
            self.wake(int(us.min()))

        def wake(self, at: int) -> None:
            first = at // 1000 + 1
            due = self.next.get()[0] if self.next.exists() else None
            if due is None or first < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.next.update((first,))
                self.handle.registerTimer(first)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
            arrived, tables, n = self.arrived.get()[0] if self.arrived.exists() else 0, [], 0
            for pdf in rows:
                us = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy()
                arrays = [us, range(arrived, arrived + len(us)), *[pdf[c] for c in inputs]]
                tables.append(pa.table([pa.array(x, f.type, from_pandas=True) for x, f in zip(arrays, held, strict=True)], schema=held))
                arrived, n = arrived + len(us), n + len(us)
                if n >= HELD_ROWS:
                    self.wait(pa.concat_tables(tables))
                    tables, n = [], 0
            if n:
                self.wait(pa.concat_tables(tables))
            self.arrived.update((arrived,))
            return iter(())

        def due(self, limit: int) -> Iterator[pa.Table]:
            """Takes the rows before ``limit`` (microseconds) out of the state, in order, slot by slot."""
            import pyarrow.compute as pc

            parts: dict[int, list[int]] = {}
            for slot, part in self.waiting.keys():  # noqa: SIM118
                parts.setdefault(slot, []).append(part)
            for slot in sorted(parts):
                table = pa.concat_tables([pa.ipc.open_stream(bytes(self.waiting.getValue((slot, part))[0])).read_all() for part in sorted(parts[slot])])
                passed = table if (slot + 1) * SLOT_US <= limit else table.filter(pc.less(table["at"], limit))
                if len(passed):
                    for part in parts[slot]:
                        self.waiting.removeKey((slot, part))
                    yield passed.take(pc.sort_indices(passed, sort_keys=order, null_placement="at_start"))
                if len(passed) < len(table):
                    rest = table.filter(pc.greater_equal(table["at"], limit))
                    if len(passed):
                        self.wait(rest)
                    else:
                        self.wake(pc.min(rest["at"]).as_py())
                    return

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: ANN001, N802, N803
            import pandas as pd

            limit = timerValues.getCurrentWatermarkInMs()
            state, last, ended, released = self.state.get() if self.state.exists() else (None, None, None, -1)
            if released == limit:
                return  # another timer of this watermark has taken all that was due
            if self.next.exists() and self.next.get()[0] <= limit:
                self.next.clear()
            step = make()
            if state is not None:
                step.state = json.loads(state)
            end = None if ended is None else (last, rank(json.loads(ended)))
            for table in self.due(limit * 1000):
                of = [table.column(i + 2).to_pylist() for i in range(len(inputs))]
                out: list[tuple] = []
                for at, *values in zip(table["at"].to_pylist(), *of, strict=True):
                    if end is not None and at <= end[0] and (at, rank([values[i] for i in ties])) <= end:
                        continue
                    last = at
                    for made in step(dict(zip(inputs, values, strict=True))):
                        out.append((at, *[values[i] for i in ties], *[made[j] for j in picked]))
                if out:
                    pdf = pd.DataFrame(out, columns=columns[len(by) :])
                    pdf[ts] = pd.to_datetime(pdf[ts], unit="us")
                    yield pdf.assign(**dict(zip(by, key, strict=True)))[columns]
            if idle is not None and last is not None and not self.next.exists() and limit * 1000 > last + idle * 1_000_000:
                self.state.clear()
                self.arrived.clear()
            else:
                # history's end matters until a newer row has come
                ended = ended if end is not None and last == end[0] else None
                self.state.update((json.dumps(step.state), last, ended, limit))
                if idle is not None and last is not None:
                    self.handle.registerTimer(last // 1000 + idle * 1000 + 1)

        def close(self) -> None:
            pass

    made = [T.StructField(machine.columns[j][0], machine.columns[j][1][0]) for j in picked]
    schema = T.StructType([*[rows.schema[c] for c in (*by, ts, *tie)], *made])
    seed = None if history is None else final_states(history, make, by=by, ts=ts, tie=tie).groupBy(*by)
    waiting = rows.select(*dict.fromkeys([*by, ts, *inputs])).where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    return waiting.groupBy(*by).transformWithStateInPandas(Steps(), outputStructType=schema, outputMode="Append", timeMode="EventTime", initialState=seed)


def live_average(bars: DataFrame, n: int = 14, wilder: bool = False, *, by: str = "sid", ts: str = "ts", delay: str = DELAY, tie: Sequence[str] = (), **options: object) -> DataFrame:
    """(by, ts, close, average) of a stream: begun with the mean of n values, recurring as in the batch operator."""
    out = live_steps(bars, lambda: Average(n, wilder), by=(by,), ts=ts, delay=delay, tie=tie, **options)
    return out.select(by, ts, "close", "average")


def live_kama(bars: DataFrame, n: int = 30, fast: int = 2, slow: int = 30, **options: object) -> DataFrame:
    """(by, ts, tie, close, kama) of a stream; the last n closes of a series are its state."""
    return live_steps(bars, lambda: Kaufman(n, fast, slow), **options)


def live_renko(bars: DataFrame, size: float | None = None, *, renko: dict | None = None, **options: object) -> DataFrame:
    """Bricks of a stream as they are drawn; the band of a series is its state."""
    return live_steps(bars, lambda: Renko(size, **(renko or {})), **options)


def day_triggers(ticks: DataFrame, delay: str = DELAY, *, by: Sequence[str] = BY) -> DataFrame:
    """One end-of-day row a series and day, when the watermark passes midnight."""
    day_end = F.date_add(F.to_date("ts"), 1).cast("timestamp")
    return ticks.withColumn("eod_ts", day_end).withWatermark("eod_ts", delay).groupBy(*by, "eod_ts").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def periodic_triggers(ticks: DataFrame, every: str, delay: str = DELAY, *, by: Sequence[str] = BY) -> DataFrame:
    """One row a series and stretch of ``every`` (metric or risk checks), when the watermark passes its end."""
    grouped = ticks.withWatermark("ts", delay).groupBy(*by, F.window("ts", every).alias("_w"))
    return grouped.agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select(*by, F.col("_w.end").alias("trigger_ts"), "n", "last_ts")


def clock_triggers(ticks: DataFrame, every: int, delay: str = DELAY, *, by: Sequence[str] = BY, ts: str = "ts", until: int | None = None) -> DataFrame:
    """One row a series for every stretch of ``every`` seconds from its first row on, silent stretches too.

    (by, trigger_ts, n, last_ts): the rows of the stretch [start, end), and the
    newest time before its end.  Each series holds one timer, at the end of its
    current stretch; when the watermark passes it the timer renews itself, so a
    series fires by the clock as long as the stream goes on, whether it has rows
    or not.  With ``until`` a series without rows for that many seconds stops
    and starts again with its next row.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    width = every * 1_000_000

    class Clock(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.next = handle.getValueState("next", "us long, last long")
            self.counts = handle.getMapState("counts", "slot long", "n long, last long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
            import numpy as np
            import pandas as pd

            us = pd.concat([pdf[ts] for pdf in rows]).astype("datetime64[us]").astype("int64").to_numpy()
            slots, inverse, n = np.unique(us // width, return_inverse=True, return_counts=True)
            newest = np.full(len(slots), np.iinfo(np.int64).min)
            np.maximum.at(newest, inverse, us)
            for slot, count, last in zip(slots.tolist(), n.tolist(), newest.tolist(), strict=True):
                was, before = self.counts.getValue((slot,)) if self.counts.containsKey((slot,)) else (0, last)
                self.counts.updateValue((slot,), (was + count, max(last, before)))
            first = (int(slots[0]) + 1) * width
            due, last = self.next.get() if self.next.exists() else (None, None)
            if due is None or first < due:
                if due is not None:
                    self.handle.deleteTimer(due // 1000)
                self.next.update((first, last))
                self.handle.registerTimer(first // 1000)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: ANN001, N802, N803
            import pandas as pd

            limit, out = timerValues.getCurrentWatermarkInMs() * 1000, []
            due, last = self.next.get()
            while due <= limit:
                slot, n = due // width - 1, 0
                if self.counts.containsKey((slot,)):
                    n, last = self.counts.getValue((slot,))
                    self.counts.removeKey((slot,))
                if until is not None and n == 0 and last is not None and due - last > until * 1_000_000:
                    waiting = [k[0] for k in self.counts.keys()]  # noqa: SIM118
                    if not waiting:
                        self.next.clear()
                        due = None
                        break
                    due = (min(waiting) + 1) * width
                    continue
                out.append((*key, pd.Timestamp(due, unit="us"), n, None if last is None else pd.Timestamp(last, unit="us")))
                due += width
            if due is not None:
                self.next.update((due, last))
                self.handle.registerTimer(due // 1000)
            if out:
                yield pd.DataFrame(out, columns=[*by, "trigger_ts", "n", "last_ts"])

        def close(self) -> None:
            pass

    stamp = ticks.schema[ts].dataType
    schema = T.StructType([*[ticks.schema[c] for c in by], T.StructField("trigger_ts", stamp), T.StructField("n", T.LongType()), T.StructField("last_ts", stamp)])
    rows = ticks.select(*by, ts).where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    return rows.groupBy(*by).transformWithStateInPandas(Clock(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _marked(batch: DataFrame, batch_id: int, marks: str, delivered: DataFrame | None, by: Sequence[str], ts: str, arrival: Sequence[str]) -> DataFrame:
    """A micro-batch with ``late`` as ``mark_late`` gives it, by windows over stretches of arrival.

    The marks (by, last_ts) that a micro-batch leaves go to one of two folders
    below ``marks`` in turn, so a repeated one finds those before it again.
    The result is persisted; the caller lets it go.
    """
    spark, schema = batch.sparkSession, T.StructType([*[batch.schema[c] for c in by], T.StructField("last_ts", batch.schema[ts].dataType)])
    if batch_id:
        before = spark.read.schema(schema).parquet(f"{marks}/{(batch_id - 1) % 2}")
    else:
        before = spark.createDataFrame([], schema) if delivered is None else delivered.select(*by, "last_ts").groupBy(*by).agg(F.max("last_ts").alias("last_ts"))
    rows = running(batch, {"_newest": ("max", F.col(ts))}, by=by, order=arrival) if arrival else batch.withColumn("_newest", F.lit(None).cast(schema["last_ts"].dataType))
    keyed = before.select(*[F.col(k).alias(f"_k_{k}") for k in by], "last_ts")
    joined = rows.join(keyed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], "left")
    late = F.coalesce(F.col(ts) < F.greatest("_newest", "last_ts"), F.lit(False))
    marked = joined.select(*batch.columns, late.alias("late")).persist()
    newest = marked.groupBy(*by).agg(F.max(ts).alias("last_ts")).unionByName(before).groupBy(*by).agg(F.max("last_ts").alias("last_ts"))
    newest.where(F.col("last_ts").isNotNull()).write.mode("overwrite").parquet(f"{marks}/{batch_id % 2}")
    return marked


def split_late(
    stream: DataFrame, path: str, late_path: str, checkpoint: str, delivered: DataFrame | None = None, *, by: Sequence[str] = BY, ts: str = "ts", arrival: Sequence[str] = ()
) -> StreamingQuery:
    """Rows on time go to ``path``, rows older than what their series has delivered by then to ``late_path``.

    The marks are those of ``mark_late``, kept below ``path``.  A micro-batch is
    written as a version of its own under both paths, so a repeated batch
    overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = _marked(batch, batch_id, f"{path}/_marks", delivered, by, ts, arrival)
        for late, to in ((False, path), (True, late_path)):
            marked.where(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{to}/batch={batch_id}")
        marked.unpersist()

    return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hand_over(history: DataFrame, stream: DataFrame, path: str, checkpoint: str, *, by: Sequence[str] = BY) -> StreamingQuery:
    """Writes the history to ``path``, then the rows of the stream after each series' end of it, late ones left out."""
    history.select(*stream.columns).write.mode("overwrite").parquet(f"{path}/batch=-1")
    last = history.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch=-1").groupBy(*by).agg(F.max("ts").alias("last_ts"))
    # rows of the time at which history ended are its own
    seed = last.withColumn("last_ts", F.timestamp_micros(F.unix_micros("last_ts") + 1))

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = _marked(batch, batch_id, f"{path}/_marks", seed, by, "ts", ())
        marked.where(~F.col("late")).drop("late").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        marked.unpersist()

    return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_stream(log: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = True) -> StreamingQuery:
    """Writes a metric stream to parquet, csv or json files."""
    writer = log.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], parts: int = PARTS) -> StreamingQuery:
    """Keeps the newest row of each key in the ``UpsertTable`` at ``path``; a repeated micro-batch counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        UpsertTable(batch.sparkSession, path, keys, order, parts).put(batch, batch_id)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letter_stream(rows: DataFrame, sink: Callable[[DataFrame, int], None], dead_path: str, checkpoint: str, attempts: int = 2) -> StreamingQuery:
    """Gives each micro-batch to ``sink``; one that it fails to take goes to files below ``dead_path`` and the stream goes on.

    ``sink`` must bear being called again with the same batch, as every
    ``foreachBatch`` sink must.  Dead letters keep their columns, with the batch,
    the time and the first line of the last error; a repeated batch replaces its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        error = None
        for _ in range(attempts):
            try:
                sink(batch, batch_id)
                break
            except Exception as e:  # noqa: BLE001 - whatever the sink raises
                error = e
        else:
            why = str(error).strip().split("\n")[0][:500]
            failed = batch.withColumns({"failed_batch": F.lit(batch_id).cast("long"), "failed_at": F.current_timestamp(), "error": F.lit(why)})
            failed.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
