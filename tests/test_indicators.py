"""Indicators against plain loops, and their bounds."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlake import registry
from barlake.functions import exprs as X
from barlake.operators import cross, recursive, rolling, scan, signals

START = datetime(2024, 1, 1)


def bars(spark, closes, sid="a"):
    rows = [(sid, START + timedelta(days=i), c, c, c, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "sid string, ts timestamp, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[0] for r in df.orderBy("sid", "ts").select(name).collect()]


def close_to(got, want):
    assert len(got) == len(want)
    assert [(g is None) for g in got] == [(w is None) for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], abs=1e-9)


def average(values, n, k):
    out, seen, y = [], [], None
    for v in values:
        if v is not None:
            seen.append(v)
            y = None if len(seen) < n else sum(seen) / n if len(seen) == n else (1 - k) * y + k * v
        out.append(y)
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(1, 100).map(float)), min_size=1, max_size=60), st.integers(2, 7))
def test_average_is_the_loop(spark, values, n):
    close_to(column(recursive.ema(bars(spark, values), n), "ema"), average(values, n, 2 / (n + 1)))


@pytest.mark.parametrize(("chunk", "group"), [(1, 1), (2, 3), (3, 2), (256, 256)])
def test_scan_does_not_depend_on_chunks(spark, chunk, group):
    values = [float(i * i % 17) for i in range(40)]
    df = bars(spark, values).union(bars(spark, values[::-1], "b")).repartition(3)
    w = F.row_number().over(rolling.series())
    df = df.withColumns({"a": F.when(w == 1, 0.0).when(F.col("close") == 3, F.lit(None)).otherwise(0.9), "b": F.when(w == 1, F.col("close")).otherwise(0.1 * F.col("close"))})
    out = scan.affine_scan(df, F.col("a"), F.col("b"), "y", chunk=chunk, group=group)

    def loop(v):
        ys, y = [], None
        for i, x in enumerate(v):
            y = x if i == 0 else y if x == 3 else 0.9 * y + 0.1 * x
            ys.append(y)
        return ys

    close_to(column(out, "y"), loop(values) + loop(values[::-1]))


def test_chained_scans_stay_small(spark):
    plan = recursive.tema(recursive.tema(bars(spark, [1.0, 2.0]), 3, name="x"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Relation") < 10


def test_rsi_bounds_and_flat(spark):
    assert column(recursive.rsi(bars(spark, [5.0] * 20), 3), "rsi")[-1] == 50
    assert column(recursive.rsi(bars(spark, [float(i) for i in range(20)]), 3), "rsi")[-1] == 100
    got = [x for x in column(recursive.rsi(bars(spark, [float(i * 7 % 11) for i in range(60)]), 5), "rsi") if x is not None]
    assert len(got) == 55 and all(0 <= x <= 100 for x in got)


def test_warm_up(spark):
    df = bars(spark, [float(i) for i in range(10)])
    assert column(rolling.sma(df, 4), "sma") == [None] * 3 + [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]
    assert column(rolling.sma(bars(spark, [1.0]), 4), "sma") == [None]
    assert registry.added(registry.joint([3, 5]), 4) == 8


def test_index_of_latest_extreme(spark):
    df = bars(spark, [1.0, 3.0, 3.0, 2.0, 0.0])
    assert column(rolling.index_highest(df, 3), "index_highest") == [None, None, 0, 1, 2]
    assert column(rolling.index_lowest(df, 3), "index_lowest") == [None, None, 2, 0, 0]


def test_crossing_waits_for_a_difference(spark):
    df = bars(spark, [1.0, 2.0, 2.0, 3.0, 1.0]).withColumn("b", F.lit(2.0))
    assert column(cross.crossover(df, "close", "b"), "crossover") == [0, 0, 0, 1, -1]


def test_safe_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 0.0), (4.0, 2.0)], "a double, b double")
    got = df.select(X.divide(F.col("a"), F.col("b")), X.div_by_zero(F.col("a"), F.col("b"), 7.0), X.div_zero_by_zero(F.col("a"), F.col("b"), 9.0, 5.0)).collect()
    assert [tuple(r) for r in got] == [(0, 7, 9), (0, 7, 5), (None, None, None), (2, 2, 2)]


def test_position_and_stop(spark):
    df = bars(spark, [10.0, 12.0, 11.0, 9.0, 10.0, 8.0]).withColumns({"go": F.col("close") == 10, "gap": F.lit(2.5)})
    got = signals.trailing_stop_positions(df, "go", "gap", tie=()).orderBy("ts").collect()
    assert [(r.position, r.stop) for r in got] == [(1, 7.5), (1, 9.5), (1, 9.5), (0, None), (1, 7.5), (1, 7.5)]


def test_two_series_unsorted(spark):
    df = bars(spark, [1.0, 2.0, 3.0]).union(bars(spark, [10.0, 20.0, 30.0], "b")).orderBy(F.rand(1)).repartition(4)
    assert column(rolling.momentum(df, 1), "momentum") == [None, 1, 1, None, 10, 10]


def test_user_operators(spark):
    registry.register("double_close", lambda df, **_: df.withColumn("d", F.col("close") * 2), 1)
    assert column(registry.run(bars(spark, [1.0, 2.0]), ["double_close"]), "d") == [2, 4]
    with pytest.raises(ValueError, match="registered"):
        registry.register("double_close", lambda df: df)
    assert column(rolling.apply_n(bars(spark, [1.0, 5.0, 3.0]), max, 2, "m"), "m") == [None, 5, 5]
    text = spark.createDataFrame([("01/02/2024",), ("x",), (None,)], "t string")
    got = [r[0] for r in text.select(registry.parse_times(F.col("t"), lambda t: datetime.strptime(t, "%d/%m/%Y"))).collect()]
    assert got == [datetime(2024, 2, 1), None, None]


def test_custom_feed(spark):
    from pyspark.sql.types import LongType, StructField, StructType

    spark.dataSource.register(registry.feed_source("squares", StructType([StructField("n", LongType())]), 3, lambda i: iter([(i * i,)])))
    assert sorted(r.n for r in spark.read.format("squares").load().collect()) == [0, 1, 4]


def test_live_average_keeps_rows_of_one_time(spark, tmp_path):
    from barlake.streaming import live

    at = [START, START, START, START + timedelta(hours=1), START + timedelta(days=9)]
    rows = [("a", t, c, k) for t, c, k in zip(at, [5.0, 1.0, 3.0, 9.0, 0.0], [3, None, 2, 1, 1], strict=True)]
    spark.createDataFrame(rows, "sid string, ts timestamp, close double, tb long").coalesce(1).write.parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for tie, closes in ((("tb",), [1.0, 3.0, 5.0, 9.0]), ((), [5.0, 1.0, 3.0, 9.0])):
            ticks = live.stream_ticks(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
            out = str(tmp_path / f"out{len(tie)}")
            live.metric_stream(live.live_average(ticks, 2, tie=tie), out, f"{out}-state").awaitTermination()
            got = spark.read.parquet(out).collect()
            assert len(got) == 4 and {r.close: r.average for r in got} == pytest.approx(dict(zip(closes, average(closes, 2, 2 / 3), strict=True)))
    finally:
        spark.conf.unset(key)
