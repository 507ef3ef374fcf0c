"""Values that cross chunk, group and stretch bounds; calendars and benchmarks before their first day."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlake.functions.windows import carried
from barlake.operators import fill, resample, signals
from barlake.operators.scan import affine_scan


def test_scan_crosses_chunks_and_groups(spark):
    rows = [("s", i, None if i < 3 or i % 11 == 5 else 0.0 if i == 3 else 0.9, float(i)) for i in range(50)] + [("t", 0, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "sid string, ts int, a double, b double")
    got = {(r.sid, r.ts): r.y for r in affine_scan(df, F.col("a"), F.col("b"), "y", chunk=4, group=3).collect()}
    want, y = {("t", 0): 7.0}, None
    for _, i, a, b in rows[:50]:
        y = y if a is None else a * (y or 0) + b
        want["s", i] = y
    assert got.keys() == want.keys() and all(got[k] is v or got[k] == pytest.approx(v) for k, v in want.items())


def test_values_are_carried_over_stretches(spark):
    at = [dt.datetime(2024, 1, d, h) for d in (1, 2, 5, 6) for h in (1, 13)]
    df = spark.createDataFrame([(t, None if i in (0, 3, 4, 5) else float(i), None if i < 6 else float(i)) for i, t in enumerate(at)], "ts timestamp, x double, y double")
    out = carried(df, ["x", "y"], (), "ts").orderBy("ts").collect()
    assert [r.x for r in out] == [None, 1, 2, 2, 2, 2, 6, 7] and [r.y for r in out] == [None] * 6 + [6, 7]
    assert carried(df.where("false"), ["x"], (), "ts").count() == 0


def test_bricks_follow_the_ladder(spark):
    closes = [100.0, None, 104.0, 105.0, 111.0, 109.0, 104.0, 94.0, 94.0]
    rows = [("s", i, 100.0, c, c, c) for i, c in enumerate(closes)]
    out = fill.renko(spark.createDataFrame(rows, "sid string, ts int, open double, high double, low double, close double"), tie=(), size=5.0).orderBy("ts").collect()
    assert [(r.ts, r.open, r.close) for r in out] == [(3, 105, 110), (4, 110, 115), (5, 110, 105), (6, 105, 100), (7, 100, 95), (8, 95, 90)]


def test_stop_positions_rearm(spark):
    rows = [("s", i, go, c, 2.0) for i, (go, c) in enumerate([(False, 9.0), (True, 10.0), (True, 12.0), (True, 9.5), (False, 9.0), (True, 8.0), (False, None), (False, 5.0)])]
    out = signals.trailing_stop_positions(spark.createDataFrame(rows, "sid string, ts int, go boolean, close double, gap double"), "go", "gap", tie=()).orderBy("ts").collect()
    assert [(r.position, r.stop) for r in out] == [(0, None), (1, 8.0), (1, 10.0), (0, None), (0, None), (1, 6.0), (1, 6.0), (0, None)]


def test_calendar_closes_bars(spark):
    rows = [("s", dt.datetime(2024, 1, d, 10), float(d)) for d in (3, 4, 5, 8, 11, 12, 15)]
    bars = spark.createDataFrame(rows, "sid string, ts timestamp, close double").select("sid", "ts", *[F.col("close").alias(c) for c in ("open", "high", "low", "close", "volume", "amount")])
    closes = spark.createDataFrame([(dt.date(2024, 1, 4),), (dt.date(2024, 1, 11),)], "day date")
    out = resample.calendar_bars(bars, closes, session_end="15:00:00").orderBy("ts").collect()
    assert [(r.ts.day, r.open, r.close) for r in out] == [(4, 3, 4), (11, 5, 11), (15, 12, 15)]
