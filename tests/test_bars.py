"""Golden rows for bar building, filling, splitting and alignment."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barlake.operators import align, calendar, fill, resample
from barlake.sources import bars as src


def T(text):  # noqa: N802
    return datetime.fromisoformat(text)


def ticks(spark, rows):
    df = spark.createDataFrame([(s, T(t), float(p), 1.0, float(p)) for s, t, p in rows], "sid string, ts timestamp, price double, volume double, amount double")
    return src.ticks_as_bars(df)


def collect(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols[:2]).collect()]


def test_edge_row_closes_its_bar(spark):
    df = ticks(spark, [("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 10:00:01", 2), ("a", "2024-01-01 10:01:00", 3), ("b", "2024-01-01 10:00:30", 9)])
    got = collect(resample.resample(df, "minutes"), "sid", "ts", "open", "close", "volume")
    assert got == [("a", T("2024-01-01 10:00:00"), 1, 1, 1), ("a", T("2024-01-01 10:01:00"), 2, 3, 2), ("b", T("2024-01-01 10:01:00"), 9, 9, 1)]


def test_left_edge_and_last_time(spark):
    df = ticks(spark, [("a", "2024-01-01 10:00:10", 1), ("a", "2024-01-01 10:00:50", 2)])
    assert collect(resample.resample(df, "minutes", right_edge=False), "sid", "ts") == [("a", T("2024-01-01 10:00:00"))]
    assert collect(resample.resample(df, "minutes", to_edge=False), "sid", "ts") == [("a", T("2024-01-01 10:00:50"))]


def test_session_end_cuts_a_bar(spark):
    df = ticks(spark, [("a", "2024-01-01 14:59:00", 1), ("a", "2024-01-01 15:00:00", 2), ("a", "2024-01-01 15:10:00", 3)])
    got = collect(resample.resample(df, "hours", 2, session_end="15:00:00"), "sid", "ts", "close")
    assert got == [("a", T("2024-01-01 15:00:00"), 2), ("a", T("2024-01-01 16:00:00"), 3)]


def test_resample_conserves_volume_and_order(spark):
    rows = [("a", f"2024-01-{d:02d} {h:02d}:15:00", d * h % 7 + 1) for d in range(1, 9) for h in range(24)]
    df = ticks(spark, rows)
    for unit, n in (("minutes", 30), ("hours", 3), ("days", 1), ("weeks", 1), ("months", 1), ("days", 3)):
        bars = resample.resample(df.repartition(5), unit, n)
        assert bars.agg(F.sum("volume")).first()[0] == len(rows)
        assert bars.where("low > least(open, close) or high < greatest(open, close)").count() == 0


def test_compress_counts_rows(spark):
    df = ticks(spark, [("a", f"2024-01-01 10:00:{s:02d}", s) for s in range(5)])
    assert collect(resample.compress(df, 2), "sid", "ts", "open", "close") == [("a", T("2024-01-01 10:00:01"), 0, 1), ("a", T("2024-01-01 10:00:03"), 2, 3), ("a", T("2024-01-01 10:00:04"), 4, 4)]


def test_empty_input(spark):
    df = ticks(spark, [("a", "2024-01-01 10:00:00", 1)]).where("false")
    assert resample.resample(df, "minutes").count() == 0
    assert fill.session_fill(df, 60, "09:00:00", "10:00:00").count() == 0
    assert fill.calendar_fill(df).count() == 0


def test_session_fill(spark):
    df = ticks(spark, [("a", "2024-01-01 10:01:00", 5), ("a", "2024-01-01 10:03:00", 7), ("a", "2024-01-02 10:01:00", 8)])
    got = collect(fill.session_fill(df, 60, "10:00:00", "10:04:00"), "ts", "close", "is_filled", "volume")
    assert got == [
        (T("2024-01-01 10:01:00"), 5, False, 1), (T("2024-01-01 10:02:00"), 5, True, None), (T("2024-01-01 10:03:00"), 7, False, 1), (T("2024-01-01 10:04:00"), 7, True, None),
        (T("2024-01-02 10:00:00"), 7, True, None), (T("2024-01-02 10:01:00"), 8, False, 1),
    ]


def test_calendar_fill_prices(spark):
    df = ticks(spark, [("a", "2024-01-05 00:00:00", 5), ("a", "2024-01-09 00:00:00", 9)])
    assert [r[1] for r in collect(fill.calendar_fill(df), "ts", "close")] == [5, 5, 5, 5, 9]
    assert [r[1] for r in collect(fill.calendar_fill(df, fill_price=3.0), "ts", "close")] == [5, 3, 3, 3, 9]
    assert [r[0].day for r in collect(fill.weekday_fill(df), "ts", "close")] == [5, 8, 9]
    assert [r[1] for r in collect(fill.weekday_fill(df), "ts", "close")] == [5, None, 9]


def test_splitters(spark):
    df = spark.createDataFrame([("a", T("2024-01-01"), 10.0, 14.0, 9.0, 12.0, 7.0)], "sid string, ts timestamp, open double, high double, low double, close double, volume double")
    assert collect(fill.split_day(df), "part", "close", "volume") == [(0, 11.0, 3.0), (1, 12.0, 4.0)]
    assert collect(fill.open_then_full(df), "part", "close", "volume") == [(0, 10.0, 0.0), (1, 12.0, 7.0)]
    assert collect(fill.ohl_then_close(df), "part", "volume") == [(0, 3.0), (1, 7.0)]


def test_renko(spark):
    df = ticks(spark, [("a", f"2024-01-01 10:00:{i:02d}", p) for i, p in enumerate([100, 104, 111, 125, 98, 97, 88])])
    got = collect(fill.renko(df, tie=(), size=10.0), "ts", "open", "close", "high", "low")
    assert [(t.second, o, c, h, l_) for t, o, c, h, l_ in got] == [(2, 110, 120, 120, 110), (3, 120, 130, 130, 120), (4, 120, 110, 120, 110), (5, 110, 100, 110, 100), (6, 100, 90, 100, 90)]


@pytest.mark.parametrize(("strict", "forward", "want"), [(False, False, [None, 1, 1, 2]), (True, False, [None, None, 1, 1]), (False, True, [1, 1, 2, 2]), (True, True, [1, 2, 2, None])])
def test_asof(spark, strict, forward, want):
    left = spark.createDataFrame([("a", T(f"2024-01-0{d}")) for d in (1, 2, 3, 4)], "sid string, ts timestamp")
    right = spark.createDataFrame([("a", T("2024-01-02"), 1), ("a", T("2024-01-04"), 2), ("b", T("2024-01-01"), 7)], "sid string, ts timestamp, v int")
    assert [r[1] for r in collect(align.asof(left, right, ["v"], strict=strict, forward=forward), "ts", "v")] == want


def test_asof_keeps_nulls_of_the_right_row(spark):
    left = spark.createDataFrame([("a", T("2024-01-03"))], "sid string, ts timestamp")
    right = spark.createDataFrame([("a", T("2024-01-01"), 1, 1), ("a", T("2024-01-02"), None, 2)], "sid string, ts timestamp, v int, w int")
    assert collect(align.asof(left, right, ["v", "w"]), "v", "w") == [(None, 2)]


def test_forward_adjust(spark):
    bars = spark.createDataFrame([("a", d, 10.0, 10.0, 10.0, 10.0, 100.0) for d in range(1, 6)], "sid string, day int, open double, high double, low double, close double, volume double")
    factors = spark.createDataFrame([("a", 3, 0.5), ("a", 5, 0.1)], "sid string, day int, factor double")
    got = collect(src.forward_adjust(bars, factors), "day", "close", "volume")
    assert [(d, round(c, 6), round(v, 6)) for d, c, v in got] == [(1, 0.5, 2000), (2, 0.5, 2000), (3, 1, 1000), (4, 1, 1000), (5, 10, 100)]


def test_chain_and_advance(spark):
    a = spark.createDataFrame([("x", T("2024-01-01"), 1), ("x", T("2024-01-03"), 2)], "sid string, ts timestamp, v int")
    b = spark.createDataFrame([("x", T("2024-01-02"), 3), ("x", T("2024-01-04"), 4), ("y", T("2024-01-01"), 5)], "sid string, ts timestamp, v int")
    assert [r[1] for r in collect(src.chain([a, b]), "sid", "v")] == [1, 2, 4, 5]
    again = a.union(a.withColumn("v", F.col("v") + 10))
    assert [r[1] for r in collect(src.advance_only(again, arrival=("v",)), "ts", "v")] == [1, 2]


def test_csv_readers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Date,O,H,L,C,V,OI\n2024-01-02,1,2,0.5,1.5,10,0\n2024-01-03,,2,0.5,1.5,10,0\n")
    got = collect(src.read_fixed_csv(spark, str(tmp_path / "f.csv"), "17:00:00"), "ts", "open", "close")
    assert got == [(T("2024-01-02 17:00:00"), 1.0, 1.5), (T("2024-01-03 17:00:00"), None, 1.5)]
    (tmp_path / "t.csv").write_text("Date,Time,O,H,L,C,V,OI\n2024-01-02,10:30:00,1,2,0.5,1.5,10,0\n")
    assert collect(src.read_fixed_csv(spark, str(tmp_path / "t.csv"), with_time=True), "ts", "open", "openinterest") == [(T("2024-01-02 10:30:00"), 1.0, 0.0)]
    (tmp_path / "m.csv").write_text("2024.01.02,10:30,1,2,0.5,1.5,10\n")
    assert collect(src.read_terminal_csv(spark, str(tmp_path / "m.csv")), "ts", "close") == [(T("2024-01-02 10:30:00"), 1.5)]
    (tmp_path / "e.csv").write_text("d;o;h;l;c;v;x\n1704187800.5;1;2;0.5;;10;0\n")
    got = collect(src.read_csv(spark, str(tmp_path / "e.csv"), date_format="epoch", separator=";", null_value=-1.0), "ts", "close")
    assert got == [(T("2024-01-02 09:30:00.500"), -1.0)]
    (tmp_path / "a.csv").write_text("h\n2024-01-02,1,1,1,1,1,0,1,2.26,2.5,2.1,2.3,9\n")
    assert collect(src.read_adjusted_csv(spark, str(tmp_path / "a.csv"), decimals=1), "open", "close", "volume") == [(2.3, 2.3, 9.0)]


def test_map_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "Open double, Close double")
    assert collect(src.map_columns(df, {"open": "open", "close": 1, "volume": None}), "open", "close", "volume") == [(1.0, 2.0, None)]


def test_calendar(spark):
    days = calendar.trading_days(spark, "2024-01-01", "2024-01-10", holidays=["2024-01-02"])
    assert [r.day.day for r in days.orderBy("day").collect()] == [1, 3, 4, 5, 8, 9, 10]
    early = spark.createDataFrame([("2024-01-05", "09:30:00", "12:00:00")], "day string, open_time string, close_time string").withColumn("day", F.to_date("day"))
    table = calendar.sessions(days, "09:30:00", "15:00:00", early)
    rows = spark.createDataFrame([(T("2024-01-05 11:00:00"),), (T("2024-01-05 12:30:00"),)], "ts timestamp")
    assert [r[1].day for r in collect(calendar.session_of(rows, table), "ts", "day")] == [5, 8]


def test_rows_long_before_the_first_mark(spark):
    days = calendar.trading_days(spark, "2024-01-01", "2024-01-10", holidays=["2024-01-02"])
    rows = spark.createDataFrame([(1, T("1990-05-01 11:00:00")), (2, T("2023-10-01 11:00:00")), (3, T("2024-01-01 15:00:00")), (4, T("2024-01-01 15:00:01")), (5, T("2024-01-10 15:00:01")), (6, None)], "k int, ts timestamp")
    got = calendar.session_of(rows, calendar.sessions(days, "09:30:00", "15:00:00"))
    assert got.columns == ["k", "ts", "day", "open_ts", "close_ts"]
    assert [(r.k, r.day and r.day.day, r.close_ts) for r in got.orderBy("k").collect()] == [
        (1, 1, T("2024-01-01 15:00:00")), (2, 1, T("2024-01-01 15:00:00")), (3, 1, T("2024-01-01 15:00:00")), (4, 3, T("2024-01-03 15:00:00")), (5, None, None), (6, None, None),
    ]
    asked = spark.createDataFrame([("1980-01-01",), ("2024-01-01",), ("2024-01-05",), ("2024-01-09",), (None,)], "day string").select(F.to_date("day").alias("day"))
    bm = spark.createDataFrame([("2024-01-01", 0.5), ("2024-01-08", 0.25)], "day string, ret double").select(F.to_date("day").alias("day"), "ret")
    found = align.benchmark_on(asked, bm)
    assert found.columns == ["day", "benchmark_day", "ret"]
    assert {str(r.day): (r.benchmark_day and r.benchmark_day.day, r.ret) for r in found.collect()} == {"1980-01-01": (1, 0.5), "2024-01-01": (1, 0.5), "2024-01-05": (8, 0.25), "2024-01-09": (None, None), "None": (None, None)}
