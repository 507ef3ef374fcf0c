"""Cases of the third review: windows that stand still, halves, events of one time."""

import math
from datetime import datetime, timedelta

from barlake.operators import rolling

START = datetime(2024, 1, 1)


def test_correlation_of_a_window_that_stands_still(spark):
    rows = [("a", START + timedelta(days=i), float(i % 5 if i < 8 else 7), float(i)) for i in range(12)]
    rows += [("b", START + timedelta(days=i), None if i == 2 else float(i), 3.0 if i < 3 else float(-i)) for i in range(6)]
    df = spark.createDataFrame(rows, "sid string, ts timestamp, close double, volume double")
    got = [r.pearson_r for r in rolling.pearson_r(df, 3).orderBy("sid", "ts").collect()]
    assert got[:2] == [None, None] and math.isclose(got[2], 1.0) and math.isnan(got[10]) and math.isnan(got[11])
    assert got[12:14] == [None, None] and math.isnan(got[14]) and math.isclose(got[17], -1.0)  # of pairs without nulls


def test_first_bricks_stand_on_halves_away_from_zero(spark):
    from barlake.operators import fill

    rows = [(s, START + timedelta(hours=i), i, *[k * x] * 4) for s, k in (("up", 1.0), ("down", -1.0)) for i, x in enumerate((2.5, 9.0, 14.0, 8.0))]
    df = spark.createDataFrame(rows, "sid string, ts timestamp, tb long, open double, high double, low double, close double")
    want = [("down", -8.0, -13.0), ("up", 8.0, 13.0)]  # around 3 and -3, not 2 and -2
    for width in (None, 3600):
        got = fill.renko(df, tie=("tb",), size=5.0, width=width)
        assert sorted((r.sid, r.open, r.close) for r in got.where("tb = 1").collect()) == want


def test_events_of_one_time_are_no_duplicates(spark, tmp_path):
    from barlake.plans import QUERIES

    rows = [(i, START + timedelta(hours=i // 3), 1, "click", 1.0) for i in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["st4_drop_duplicates"](spark, str(tmp_path)).collect()
    assert sorted(r.tb for r in got) == list(range(9))


def test_waiting_rows_lie_in_blocks(spark, tmp_path):
    from barlake.operators.steps import Average
    from barlake.streaming import live

    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.range(2000).selectExpr("'a' sid", "timestamp_micros(1704067200000000 + id * 1000000) ts", "id tb", "cast(id as double) close")
        rows.write.parquet(str(tmp_path / "in"))
        out = live.live_steps(live.stream_ticks(spark, str(tmp_path / "in"), rows.schema), lambda: Average(3), tie=("tb",))
        stream = live.metric_stream(out, str(tmp_path / "out"), str(tmp_path / "state"))
        stream.awaitTermination()
        assert 0 < stream.recentProgress[0]["stateOperators"][0]["numRowsTotal"] < 100
    finally:
        spark.conf.unset(store)


def test_late_marks_need_no_state_in_python(spark, tmp_path):
    from barlake.streaming import live

    schema = "sid string, ts timestamp, tb long"
    hour = lambda h: START + timedelta(hours=h)
    path, seed = str(tmp_path / "in"), spark.createDataFrame([("a", hour(1))], "sid string, last_ts timestamp")
    for batch in ([("a", hour(2), 1), ("a", hour(0), 2), (None, hour(5), 3), (None, hour(4), 4)], [("a", hour(1), 5), ("a", hour(3), 6), (None, hour(4), 7), ("b", None, 8)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        rows = live.stream_ticks(spark, path, spark.createDataFrame([], schema).schema)
        stream = live.split_late(rows, str(tmp_path / "on"), str(tmp_path / "late"), str(tmp_path / "state"), seed, arrival=("tb",))
        stream.awaitTermination()
        assert stream.recentProgress[0]["stateOperators"] == []
    assert sorted(r.tb for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [2, 4, 5, 7]
    assert sorted(r.tb for r in spark.read.parquet(str(tmp_path / "on")).collect()) == [1, 3, 6, 8]


def test_scans_of_the_same_rows_share_a_pass(spark, sf_dir):
    from barlake.plans import QUERIES

    for name, passes in (("rc1_ema", 1), ("rc7_rsi", 1), ("wn16_price_oscillator_ema", 1), ("rc5_macd", 2)):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == passes and "amount" not in plan.split("Generate explode")[1], name


def test_step_machines_get_their_inputs_alone(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    from barlake.operators.steps import Step
    from barlake.operators.stepwise import stepwise

    class Shown(Step):
        inputs = ("n", "x", "flag", "name", "day")
        columns = (("seen", (T.StringType(), pa.string())),)

        def __call__(self, row):
            return [(str(row),)] if row["n"] != 0 else []

    schema = "sid string, ts timestamp, tb long, n long, x double, flag boolean, name string, day date, nothing double"
    values = [(2**62 + 1, 0.5, True, "a", START.date()), (None, None, None, None, None), (0, 0.0, False, "", START.date()), (-3, math.inf, False, "a", None)]
    df = spark.createDataFrame([("s" if i < 3 else None, START, i, *v, None) for i, v in enumerate(values)], schema)
    got = {r.tb: r.seen for r in stepwise(df, Shown, by=("sid",), ts="ts", tie=("tb",)).collect()}
    assert got == {i: str(dict(zip(Shown.inputs, v, strict=True))) for i, v in enumerate(values) if i != 2}
    assert stepwise(df.where("n = 0"), Shown, by=("sid",), ts="ts", tie=("tb",)).count() == 0


def test_positions_go_on_from_a_saved_state():
    import json

    from barlake.operators.steps import TEXT, EventHolding

    def row(day, sid, kind, n=None, price=None, buy=None, grow=None, paid=None, to=None):
        return {"_day": day, "sid": sid, "_kind": kind, "executed_size": n, "executed_price": price, "is_buy": buy, "_grow": grow, "_paid": paid, "_price": price, "_to": to}

    rows = [row(1, "a", "fill", 10, 2.0, True), row(1, "b", "fill", 4, 1.0, True), row(2, "a", "bonus", grow=1.5, paid=0.2), row(2, "a", "fill", 3, 2.0, False), row(2, "a", "fill", 13, 2.0, False), row(3, "a", "ended", price=6.0, grow=0.5, to="b"), row(3, "b", "fill", 10, 1.0, False), row(4, "b", "rights", price=1.0, grow=1.1, paid=0.1)]
    whole, want = EventHolding(TEXT), []
    for r in rows:
        want += whole(r)
    assert [w[:4] for w in want] == [("a", "fill", 10, 0), ("b", "fill", 4, 0), ("a", "bonus", 15, 15), ("a", "fill", 12, 12), ("a", "ignored", 12, 12), ("a", "ended", 0, 0), ("b", "merged", 10, 10), ("b", "fill", 0, 0)]
    got, state = [], json.dumps(EventHolding(TEXT).state)
    for r in rows:
        step = EventHolding(TEXT)
        step.state = json.loads(state)
        got += step(r)
        state = json.dumps(step.state)
    assert got == want and json.loads(state) == whole.state == [4, []]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_a_pivoted_log_is_shuffled_once(spark, sf_dir):
    from barlake.plans import QUERIES
    from barlake.sources import sinks

    assert shuffles(QUERIES["snk5_metric_pivot"](spark, sf_dir)) == 1
    at = lambda i: START + timedelta(hours=i)
    rows = [("a", at(0), "volume", 1.0, 1), ("a", at(1), "close", 5.0, 3), ("a", at(1), "close", 9.0, 2), ("a", at(2), "other", 7.0, 4), ("a", at(3), "close", 6.0, 5), ("a", at(3), "close", None, 6), ("a", at(4), None, 8.0, 7), ("a", at(5), "volume", 2.0, 8), ("a", at(5), "volume", 3.0, None), ("b", at(9), "close", 4.0, 9)]
    log = spark.createDataFrame(rows, "sid string, ts timestamp, metric string, value double, arrival long")
    got = sorted((r.sid, r.ts, r.close, r.volume) for r in sinks.metric_pivot(log, ["close", "volume"], by=("sid",)).collect())
    assert got == [("a", at(1), 5.0, 1.0), ("a", at(2), 5.0, 1.0), ("a", at(3), 5.0, 1.0), ("a", at(4), 5.0, 1.0), ("a", at(5), 5.0, 2.0), ("b", at(9), 4.0, None)]


def test_adjusted_and_raw_prices_are_read_in_one_pass(spark, tmp_path):
    import gzip

    from barlake.plans import QUERIES
    from barlake.sources import bars

    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    rows = [(1, 1, 7, 1, 2.0, 10.0, START), (1, 2, 7, 2, 1.0, 9.0, START), (2, 1, None, 1, 4.0, 10.0, START)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["src6_adjusted_csv"](spark, str(tmp_path))
    assert shuffles(found) == 0 and len(found.inputFiles()) and all(f.endswith(".csv.gz") for f in found.inputFiles())
    day = "2024-01-01 00:00:00"
    assert {tuple(r) for r in found.collect()} == {(7, day, 2.5, 4.5, 2.5, 4.5, 9.0), (None, day, 1.25, 1.25, 1.25, 1.25, 2.5)}  # a bar without series too
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("h\n2024-01-02,1,1,1,1.26,8,0,1,2.26,2.5,2.1,2.3,9\n2024-01-03,1,1,1,,8,0,1,2,2,2,2,\n")
    got = bars.read_adjusted_csv(spark, str(tmp_path / "a.csv.gz"), decimals=1, raw=("close", "volume")).orderBy("ts").collect()
    assert [(r.open, r.close, r.volume, r.raw_close, r.raw_volume) for r in got] == [(2.3, 2.3, 9.0, 1.3, 8.0), (2.0, 2.0, None, None, 8.0)]
