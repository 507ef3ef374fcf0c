"""Hot series: stretches and levels give what one window or one loop gives."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.functions.windows import expanding, position
from barlake.operators import rolling, scan, stretches

START = datetime(2024, 1, 1)
KEY = {"by": ("sid",), "order": ("ts", "tb")}


def rows_of(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):  # one series has most of the rows; times with ties, gaps of days, and without time
        sid = None if i % 50 == 7 else "hot" if rng.random() < 0.8 else str(rng.choice(list("abc")))
        ts = None if i % 97 == 5 else START + timedelta(hours=int(rng.integers(0, 30)) + 200 * int(rng.integers(0, 4)))
        rows.append((sid, ts, i, None if rng.random() < 0.2 else float(rng.integers(-50, 50))))
    return spark.createDataFrame(rows, "sid string, ts timestamp, tb long, close double").repartition(4)


def same(got, want, *columns):
    pick = lambda df: sorted(((r.tb, *[r[c] if not isinstance(r[c], float) else round(r[c], 6) for c in columns]) for r in df.collect()), key=lambda x: x[0])
    assert pick(got) == pick(want)


def test_running_values_are_the_windows(spark):
    df, w, v = rows_of(spark), expanding(**KEY), F.col("close")
    want = df.withColumns({"s": F.sum(v).over(w), "c": F.count(v).over(w), "lo": F.min(v).over(w), "hi": F.max(v).over(w), "f": F.first(v, True).over(w), "l": F.last(v, True).over(w), "n": position(**KEY)})
    got = stretches.running(df, {"s": ("sum", v), "c": ("count", v), "lo": ("min", v), "hi": ("max", v), "f": ("first", v), "l": ("last", v)}, width=36_000, **KEY)
    same(stretches.numbered(got, "n", width=7200, **KEY), want, "s", "c", "lo", "hi", "f", "l", "n")
    assert stretches.numbered(df.limit(0), **KEY).count() == 0
    with pytest.raises(ValueError, match="no such"):
        stretches.running(df, {"x": ("median", v)}, **KEY)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_windows_in_stretches(spark, n):
    df = rows_of(spark, seed=n)

    def both(rows, by):
        rows = rolling.sma(rows, n, "close", "sma", by=by, order=KEY["order"])
        return rolling.highest(rows, n, "close", "top", by=by, order=KEY["order"])

    got = stretches.in_stretches(df, n - 1, both, width=36_000, rows=9, **KEY)
    same(got, both(df, ("sid",)), "sma", "top")
    with pytest.raises(ValueError, match="stretches"):
        stretches.in_stretches(df, 10, both, rows=9, **KEY)


def test_stretches_spread_a_hot_series(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("sid"), F.col("id").alias("ts"), F.col("id").cast("double").alias("close"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = stretches.in_stretches(df, 3, lambda rows, by: rolling.sma(rows, 4, by=by).withColumn("task", F.spark_partition_id()), width=500, rows=1000)
        assert seen.select("task").distinct().count() > 1 and seen.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ran = stretches.numbered(df, width=500)
    assert ran.where("n <> ts + 1").count() == 0


@pytest.mark.parametrize("width", [None, 36_000])
def test_three_levels_of_maps(spark, width):
    rng = np.random.default_rng(4)
    n = 900
    a = [None if rng.random() < 0.1 else 0.0 if rng.random() < 0.02 or i == 3 else float(rng.random()) for i in range(n)]
    b = [None if rng.random() < 0.1 else float(rng.random()) for _ in range(n)]
    df = spark.createDataFrame([(("hot", "cold", None)[i % 40 // 38 + (i % 40 == 39)], START + timedelta(hours=i // 3), i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "sid string, ts timestamp, tb long, a double, b double").repartition(4)
    want, last = {}, {}
    for r in df.orderBy("tb").collect():
        y = last.get(r.sid)
        if r.a is not None and r.b is not None:
            y = r.b if r.a == 0 else None if y is None else r.a * y + r.b
        want[r.tb] = last[r.sid] = y
    got = scan.affine_scan(df, F.col("a"), F.col("b"), "y", chunk=3, group=4, width=width, **KEY)  # lists of at most four maps
    found = {r.tb: r.y for r in got.collect()}
    assert found == {k: v if v is None else pytest.approx(v) for k, v in want.items()} and sum(v is not None for v in want.values()) > 800


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("length", [1, 5, 40])
def test_spans_are_leaps_of_the_machine(seed, length):
    from barlake.operators import spans, steps

    rng = np.random.default_rng(seed)
    price = 50 + np.cumsum(rng.integers(-3, 4, 300))
    rows = [{"go": bool(rng.random() < 0.3), "gap": None if rng.random() < 0.05 else float(rng.integers(0, 9)), "close": None if rng.random() < 0.08 else float(p), "open": float(p), "high": float(p) + 2, "low": float(p) - 2, "_open": None} for p in price]
    rows[0]["close"] = None
    begun = next(r["open"] for r in rows if r["close"] is not None)
    for r in rows:
        r["_open"] = begun
    for make, plain in ((lambda: spans.SpanStop("go", "gap"), lambda: steps.ArmedStop("go", "gap")), (lambda: spans.SpanRenko(2.0), lambda: steps.Renko(2.0)), (lambda: spans.SpanRenko(3.0, hilo=True), lambda: steps.Renko(3.0, hilo=True))):
        leaping, walking = make(), plain()
        for a in range(0, len(rows), length):
            part = rows[a : a + length]
            leaping.leap(make().summary(part))
            for row in part:
                walking(row)
            assert leaping.state == walking.state
        # and from states that this series never had
        for state in ([30.0], [95.0], [None]) if isinstance(walking, steps.ArmedStop) else ([begun + 40 * leaping.size, begun + 41 * leaping.size, leaping.size], [begun - 90 * leaping.size, begun - 89 * leaping.size, leaping.size]):
            leaping.state, walking.state = list(state), list(state)
            leaping.leap(make().summary(rows[:length]))
            for row in rows[:length]:
                walking(row)
            assert leaping.state == walking.state


def test_spans_give_the_loops_rows(spark):
    from barlake.operators import fill, signals, spans

    rng = np.random.default_rng(8)
    rows = []
    for sid, n in (("hot", 500), ("cold", 30), (None, 5)):
        for i, p in enumerate(60 + np.cumsum(rng.integers(-3, 4, n))):
            rows.append((sid, START + timedelta(hours=i // 4), i, float(p), float(p) + 1, float(p) - 1, None if i % 11 == 0 else float(p), bool(rng.random() < 0.2), 5.0))
    df = spark.createDataFrame(rows, "sid string, ts timestamp, tb long, open double, high double, low double, close double, go boolean, gap double").repartition(4)
    was, spans.ROWS = spans.ROWS, 16
    try:
        many = lambda f: sorted(map(repr, f.collect()))
        assert many(fill.renko(df, tie=("tb",), size=2.0, width=36_000)) == many(fill.renko(df, tie=("tb",), size=2.0))
        assert many(signals.trailing_stop_positions(df, "go", "gap", tie=("tb",), width=36_000)) == many(signals.trailing_stop_positions(df, "go", "gap", tie=("tb",)))
        got = spans.in_spans(df, lambda: spans.SpanStop("go", "gap"), by=("sid",), ts="ts", tie=("tb",), rows=16, width=36_000)
        assert many(got) == many(signals.trailing_stop_positions(df, "go", "gap", tie=("tb",)))
    finally:
        spans.ROWS = was
    with pytest.raises(ValueError, match="dynamic"):
        fill.renko(df, tie=("tb",), dynamic=True, width=36_000)


def test_operators_of_hot_series(spark):
    from barlake.operators import ledger, performance, resample

    rng = np.random.default_rng(6)
    rows = [("hot" if i % 5 else "cold", START + timedelta(hours=6 * (i // 3)), i, int(rng.integers(1, 9)), float(rng.integers(5, 50)), bool(rng.random() < 0.6)) for i in range(300)]
    fills = spark.createDataFrame(rows, "sid string, executed_dt timestamp, order_id long, executed_size long, executed_price double, is_buy boolean").repartition(4)
    key = {"by": ("sid",), "order": ("executed_dt", "order_id")}
    many = lambda df, *c: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select("order_id", *c).collect())
    for f, c in ((ledger.position_ledger, ("size_after", "cost_basis")), (ledger.availability, ("available",))):
        assert many(f(fills, width=200_000, **key), *c) == many(f(fills, **key), *c)
    equity = fills.withColumn("value", F.when(F.col("order_id") % 9 != 0, F.col("executed_price")))
    shown = ("peak", "drawdown", "dd_len", "max_drawdown", "max_dd_len")
    nulls = lambda df: sorted(map(repr, df.select("order_id", *shown).collect()))
    assert nulls(performance.drawdown(equity, width=200_000, **key)) == nulls(performance.drawdown(equity, **key))
    bars = fills.select("sid", F.col("executed_dt").alias("ts"), F.col("order_id").alias("tb"), *[F.col("executed_price").alias(c) for c in ("open", "high", "low", "close", "amount")], F.lit(1.0).alias("volume"))
    plain, cut = (sorted(map(repr, resample.compress(bars, 7, tie=("tb",), width=w).collect())) for w in (None, 200_000))
    assert plain == cut and len(plain) == 9 + 35
