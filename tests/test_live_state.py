"""Streams with state by series: micro-batches out of order, seeds from history, timers, step machines."""

import json
from datetime import datetime, timedelta

import pytest

from barlake.operators import fill, recursive, signals, steps
from barlake.operators.stepwise import final_states, stepwise
from barlake.streaming import live

START = datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STORE)


def at(hours):
    return START + timedelta(hours=hours)


class Feed:
    """A stream whose next micro-batch is what ``put`` has added since the last one."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path / "in"), schema, 0
        self.out, self.state = str(path / "out"), str(path / "state")

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return live.stream_ticks(self.spark, self.path, self.spark.createDataFrame([], self.schema).schema)

    def run(self, made):
        live.metric_stream(made(self.stream()), self.out, self.state).awaitTermination()
        return self.spark.read.parquet(self.out).collect()


def test_the_mark_advances_with_every_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path, "sid string, ts timestamp, tb long")
    out, side = str(tmp_path / "on"), str(tmp_path / "late")
    for batch in ([("a", at(10), 1), ("b", at(5), 2)], [("a", at(9), 3), ("a", at(11), 4), ("b", at(5), 5)], [("a", at(8), 6), ("a", at(11), 7), ("c", at(1), 8), ("c", None, 9)]):
        feed.put(batch)
        live.split_late(feed.stream(), out, side, feed.state).awaitTermination()
    assert sorted(r.tb for r in spark.read.parquet(side).collect()) == [3, 6]
    assert sorted(r.tb for r in spark.read.parquet(out).collect()) == [1, 2, 4, 5, 7, 8, 9]


def test_arrival_order_counts_within_a_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path, "sid string, ts timestamp, tb long")
    feed.put([("a", at(2), 1), ("a", at(1), 2), ("a", at(2), 3), ("a", at(0), 4)])
    seed = spark.createDataFrame([("a", at(1)), ("z", at(9))], "sid string, last_ts timestamp")
    got = feed.run(lambda s: live.mark_late(s, seed, arrival=("tb",)))
    assert {r.tb: r.late for r in got} == {1: False, 2: True, 3: False, 4: True}


def test_hand_over_has_no_row_twice(spark, tmp_path):
    feed = Feed(spark, tmp_path, "sid string, ts timestamp, tb long")
    history = spark.createDataFrame([("a", at(0), 1), ("a", at(1), 2)], feed.schema)
    for batch in ([("a", at(0), 1), ("a", at(1), 2), ("a", at(2), 3)], [("a", at(1), 4), ("b", at(0), 5)]):
        feed.put(batch)
        live.hand_over(history, feed.stream(), feed.out, feed.state).awaitTermination()
    assert sorted(r.tb for r in spark.read.parquet(feed.out).collect()) == [1, 2, 3, 5]


WAVE = [5.0, 6.5, 4.0, None, 9.0, 9.0, 2.5, 11.0, 10.5, 3.0, 8.0, 8.0, 12.0, 1.0]


@pytest.mark.parametrize("machine", ["average", "kama", "renko"])
def test_history_and_stream_are_one_series(spark, tmp_path, machine):
    make = {"average": lambda: steps.Average(3), "kama": lambda: steps.Kaufman(4), "renko": lambda: steps.Renko(2.0)}[machine]
    schema = "sid string, ts timestamp, tb long, open double, high double, low double, close double"
    rows = [(s, at(i // 2), i, x, x, x, x) for s in "ab" for i, x in enumerate(WAVE)]  # two rows of each time
    table = spark.createDataFrame(rows, schema)
    whole = stepwise(table, make, by=("sid",), ts="ts", tie=("tb",))
    history = table.where("tb < 5")  # ends between two rows of one time
    feed = Feed(spark, tmp_path, schema)
    for low, high in ((3, 9), (9, 14)):  # the first overlaps history
        feed.put([r for r in rows if low <= r[2] < high])
        got = feed.run(lambda s: live.live_steps(s, make, tie=("tb",), history=history))
    feed.put([("c", at(500), 0, 1.0, 1.0, 1.0, 1.0)])  # moves the watermark past all rows
    got = feed.run(lambda s: live.live_steps(s, make, tie=("tb",), history=history))
    want = {tuple(r) for r in whole.collect() if r.tb >= 5}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_machines_are_the_batch_operators(spark):
    rows = [("a", at(i), x) for i, x in enumerate([x for x in WAVE if x is not None] * 3)]
    table = spark.createDataFrame(rows, "sid string, ts timestamp, close double")
    for make, batch, name in ((lambda: steps.Average(4, name="y"), recursive.ema(table, 4), "ema"), (lambda: steps.Average(4, True, name="y"), recursive.wilder(table, 4), "wilder"), (lambda: steps.Kaufman(5, name="y"), recursive.kama(table, 5), "kama")):
        got = {r.ts: r.y for r in stepwise(table, make, by=("sid",), ts="ts", tie=()).collect()}
        want = {r.ts: r[name] for r in batch.collect()}
        assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_states_survive_json(spark):
    rows = spark.createDataFrame([("a", at(i), i, x) for i, x in enumerate(WAVE)], "sid string, ts timestamp, tb long, close double")
    (r,) = final_states(rows, lambda: steps.Kaufman(4), by=("sid",), ts="ts", tie=("tb",)).collect()
    step = steps.Kaufman(4)
    for x in WAVE:
        step({"close": x})
    assert json.loads(r.state) == step.state and (r.last_ts, json.loads(r.last_tie)) == (at(13), [13])
    assert final_states(rows.limit(0), lambda: steps.Kaufman(4), by=("sid",), ts="ts").count() == 0


def test_idle_series_begin_anew(spark, tmp_path):
    feed = Feed(spark, tmp_path, "sid string, ts timestamp, close double")
    made = lambda s: live.live_steps(s, lambda: steps.Average(1), idle=24 * 3600)
    for batch in ([("a", at(0), 4.0), ("b", at(0), 4.0)], [("b", at(20), 8.0), ("z", at(30), 0.0)], [("z", at(40), 0.0)], [("a", at(60), 7.0), ("b", at(42), 2.0)], [("z", at(200), 0.0)]):
        feed.put(batch)
        got = feed.run(made)
    a = [r.average for r in sorted((r for r in got if r.sid == "a"), key=lambda r: r.ts)]
    b = [r.average for r in sorted((r for r in got if r.sid == "b"), key=lambda r: r.ts)]
    assert a == [4.0, 7.0] and b == [4.0, 8.0, 2.0]  # k is 1 for n = 1: both end at the value


def test_silent_series_fire_by_the_clock(spark, tmp_path):
    feed = Feed(spark, tmp_path, "sid string, ts timestamp")
    made = lambda s: live.clock_triggers(s, 3600, "0 seconds")
    for batch in ([("a", at(0.5)), ("a", at(0.7)), ("b", at(2.2))], [("b", at(5.5))], [("a", at(7.1)), ("b", at(9.2))]):
        feed.put(batch)
        got = feed.run(made)
    a = sorted((r.trigger_ts, r.n, r.last_ts) for r in got if r.sid == "a")
    assert [t for t, _, _ in a] == [at(h) for h in range(1, 10)]
    assert [n for _, n, _ in a] == [2, 0, 0, 0, 0, 0, 0, 1, 0]
    assert a[5][2] == at(0.7) and a[-1][2] == at(7.1)
    assert sum(r.n for r in got if r.sid == "b") == 2


def test_clocks_stop_for_gone_series(spark, tmp_path):
    feed = Feed(spark, tmp_path, "sid string, ts timestamp")
    made = lambda s: live.clock_triggers(s, 3600, "0 seconds", until=2 * 3600)
    for batch in ([("a", at(0.5)), ("b", at(9.5))], [("a", at(20.5)), ("b", at(22))]):
        feed.put(batch)
        got = feed.run(made)
    assert sorted(r.trigger_ts for r in got if r.sid == "a") == [at(1), at(2), at(21), at(22)]


def test_ties_decide_whatever_the_input_order(spark):
    rows = [("a", at(0), i, x, x, x, x, i % 2 == 0, 1.0) for i, x in enumerate([10.0, 13.0, 8.0, 15.0, 4.0, 12.0])]
    schema = "sid string, ts timestamp, tb long, open double, high double, low double, close double, go boolean, gap double"
    bricks, stops = set(), set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, schema).repartition(3)
        bricks.add(tuple(map(tuple, fill.renko(df, tie=("tb",), size=2.0).orderBy("tb").collect())))
        stops.add(tuple(map(tuple, signals.trailing_stop_positions(df, "go", "gap", tie=("tb",)).orderBy("tb").collect())))
    assert len(bricks) == len(stops) == 1 and len(next(iter(bricks))) == 5


def test_upserts_stay_few_and_whole(spark, tmp_path):
    from barlake.sources.upserts import UpsertTable

    table = UpsertTable(spark, f"file://{tmp_path}/t", ["k"], ["n"], parts=3)
    frame = lambda rows: spark.createDataFrame(rows, "k string, n long, v string")
    assert table.read(frame([])).count() == 0
    want = {}
    for batch in range(8):
        rows = [(k, batch, f"{k}{batch}") for k in ("a", "b", "cdefghij"[batch])]
        table.put(frame(rows), batch)
        old = table.read(frame([]))
        want.update({k: v for k, _, v in rows})
        assert {r.k: r.v for r in old.collect()} == want
        assert len(list((tmp_path / "t" / "part").iterdir())) <= 3 + 4 and len([p for p in (tmp_path / "t" / "manifest").iterdir() if p.name.isdigit()]) <= 2
    table.put(frame([("a", 99, "again")]), 2)  # a repeated batch that a snapshot has
    assert {r.k: r.v for r in table.read(frame([])).collect()} == want
    table.put(frame([("a", 7, "a7"), ("b", 7, "b7"), ("j", 7, "j7")]), 7)  # a repeated batch that is a part of its own
    before = table.read(frame([]))
    table.put(frame([("z", 8, "z8")]), 8)
    assert before.count() == len(want)  # readers of the version before go on
    assert {r.k for r in table.read(frame([])).collect()} == {*want, "z"}


def test_what_a_sink_refuses_is_kept(spark, tmp_path):
    feed, seen, dead = Feed(spark, tmp_path, "sid string, n long, ts timestamp"), [], str(tmp_path / "dead")

    def sink(batch, batch_id):
        seen.append(batch_id)
        if batch.where("n < 0").count():
            raise ValueError("negative\nand more")

    for batch in ([("a", 1)], [("a", -1), ("b", 2)], [("c", 3)]):
        feed.put([(*r, START) for r in batch])
        live.dead_letter_stream(feed.stream(), sink, dead, feed.state).awaitTermination()
    got = spark.read.parquet(dead).collect()
    assert sorted((r.sid, r.n, r.failed_batch, r.error) for r in got) == [("a", -1, 1, "negative"), ("b", 2, 1, "negative")]
    assert seen == [0, 1, 1, 2]
