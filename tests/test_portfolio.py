"""Ledgers, execution and performance on hand-made rows; sinks; registered queries."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barlake.operators import allocate, execution, ledger, performance
from barlake.sources import sinks


def T(text):  # noqa: N802
    return datetime.fromisoformat(text)


FILL = "experiment_id string, sid string, order_id string, executed_dt timestamp, executed_size long, executed_price double, comm double, is_buy boolean"


def fills(spark, rows):
    return spark.createDataFrame([("e", "a", str(i), T(t), q, p, c, b) for i, (t, q, p, c, b) in enumerate(rows)], FILL)


def test_ledger_averages_and_clears(spark):
    df = fills(spark, [("2024-01-01", 10, 10.0, 1.0, True), ("2024-01-02", 10, 20.0, 1.0, True), ("2024-01-03", 5, 30.0, 1.0, False), ("2024-01-04", 15, 30.0, 1.0, False), ("2024-01-05", 4, 7.0, 1.0, True)])
    got = ledger.position_ledger(df).orderBy("executed_dt").collect()
    assert [(r.size_after, r.cost_basis) for r in got] == [(10, 10), (20, 15), (15, 15), (0, 0), (4, 7)]
    cash = ledger.cash_ledger(df, 1000.0).orderBy("ts").collect()
    assert cash[-1].cash == 1000 - 100 - 200 + 150 + 450 - 28 - 5
    closed = performance.closed_positions(df).collect()
    assert [(r.trades, r.pnl, r.days) for r in closed] == [(4, 296.0, 3)]


def test_availability(spark):
    df = fills(spark, [("2024-01-01 10:00:00", 10, 1.0, 0.0, True), ("2024-01-01 11:00:00", 5, 1.0, 0.0, False), ("2024-01-02 10:00:00", 8, 1.0, 0.0, False), ("2024-01-03 10:00:00", 1, 1.0, 0.0, False)])
    assert [r.available for r in ledger.availability(df).orderBy("executed_dt").collect()] == [0, -5, -3, -4]
    assert ledger.oversells(df).count() == 3


def test_fills_never_exceed_size_or_cap(spark):
    bars = spark.createDataFrame([("a", T(f"2024-01-01 10:0{i}:00"), 1.0, 1.0, 1.0, 1.0, float(v)) for i, v in enumerate((100, 40, 0, 1000))], "sid string, ts timestamp, open double, high double, low double, close double, volume double")
    orders = spark.createDataFrame([("x", "a", T("2024-01-01 10:01:00"), 30), ("y", "a", T("2024-01-02 10:00:00"), 30)], "order_id string, sid string, created_dt timestamp, size long")
    got = execution.capped_fills(orders, bars, 0.5).orderBy("executed_dt").collect()
    assert [(r.order_id, r.executed_size) for r in got] == [("x", 20), ("x", 10)]
    slices = execution.vwap_schedule(orders, bars, 10).orderBy("bar_ts")
    assert [r.target for r in slices.collect()] == [30]
    assert [r.target for r in execution.twap_schedule(orders, bars, 10).orderBy("bar_ts").collect()] == [10, 10, 10]
    assert [r.target for r in execution.carry_small(execution.twap_schedule(orders, bars, 10), 20.0, tie=()).orderBy("bar_ts").collect()] == [20, 10]


def test_performance(spark):
    eq = spark.createDataFrame([("e", i, v) for i, v in enumerate([100.0, 110.0, 99.0, 99.0, 121.0])], "experiment_id string, day int, value double")
    got = performance.calmar(eq).orderBy("day").collect()
    assert [r.dd_len for r in got] == [0, 0, 1, 2, 0] and got[-1].max_drawdown == pytest.approx(0.1) and got[-1].max_dd_len == 2
    assert got[-1].calmar == pytest.approx((1.21 ** (252 / 5) - 1) / 0.1)
    ret = performance.time_return(eq)
    s = performance.sharpe(ret).orderBy("day").collect()
    assert s[0].sharpe is None and s[1].sharpe is None and s[2].sharpe is not None
    flat = eq.withColumn("value", F.lit(5.0))
    assert {r.sharpe for r in performance.sharpe(performance.time_return(flat)).collect()} == {None}
    assert {r.calmar for r in performance.calmar(flat).collect()} == {0.0}
    stats = performance.period_stats(ret).orderBy("day").collect()[-1]
    assert (stats.positive, stats.negative, stats.nochange) == (2, 1, 1)


def test_corporate_actions(spark):
    pos = spark.createDataFrame([("a", 1, 100, 10.0), ("b", 1, 100, 10.0)], "sid string, day int, size long, cost_basis double")
    bonus = spark.createDataFrame([("a", 1, 3.0, 2.0, 1.0)], "sid string, day int, bonus_share double, transfer double, bonus double")
    got = {r.sid: (r.size, round(r.cost_basis, 6), r.cash_in) for r in ledger.apply_bonus(pos, bonus).collect()}
    assert got == {"a": (150, 6.666667, 10.0), "b": (100, 10.0, 0.0)}
    rights = spark.createDataFrame([("a", 1, 3.0, 5.0)], "sid string, day int, ratio double, price double")
    got = {r.sid: (r.size, round(r.cost_basis, 6), r.cash_in) for r in ledger.apply_rights(pos, rights).collect()}
    assert got == {"a": (130, 8.846154, -150.0), "b": (100, 10.0, 0.0)}


def test_rebalance(spark):
    held = spark.createDataFrame([("e", 1, "old", 10.0, 10.0, 9), ("e", 1, "cut", 5.0, 10.0, 1), ("e", 1, "keep", 10.0, 10.0, 9)], "experiment_id string, day int, sid string, price double, cost_basis double, days_held int")
    ranked = spark.createDataFrame([(1, "keep", 1), (1, "cut", 2), (1, "new", 3), (1, "next", 4)], "day int, sid string, rank int")
    accounts = spark.createDataFrame([("e", 1, 0.05, 50000.0)], "experiment_id string, day int, drawdown double, cash double")
    got = {(r.sid, r.action, r.reason, r.priority) for r in allocate.rebalance_plan(held, ranked, accounts, slots=2).collect()}
    assert got == {("cut", "sell", "stop", 0), ("old", "sell", "expired", 1), ("new", "buy", "ranked", 2)}
    poor = accounts.withColumn("cash", F.lit(1.0))
    assert {r.action for r in allocate.rebalance_plan(held, ranked, poor).collect()} == {"sell"}
    deep = accounts.withColumn("drawdown", F.lit(0.5))
    assert {(r.action, r.reason) for r in allocate.rebalance_plan(held, ranked, deep).collect()} == {("sell", "drawdown")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(T("2024-01-01"), 1.0, math.nan), (T("2024-01-02"), None, 2.0)], "ts timestamp, close double, volume double")
    log = sinks.metric_log(df, ["close", "volume"])
    assert sorted((r.metric, r.value) for r in log.collect()) == [("close", 1.0), ("volume", 2.0)]
    wide = sinks.metric_pivot(log, ["close", "volume"]).orderBy("ts").collect()
    assert [(r.close, r.volume) for r in wide] == [(1.0, None), (1.0, 2.0)]
    for kind, write in (("parquet", sinks.write_parquet), ("csv", sinks.write_csv), ("json", sinks.write_jsonl)):
        write(log, str(tmp_path / kind))
        write(log, str(tmp_path / kind))
        read = spark.read.csv(str(tmp_path / kind), header=True) if kind == "csv" else getattr(spark.read, kind)(str(tmp_path / kind))
        assert read.count() == 4
    sinks.write_with_dead_letters(log, str(tmp_path / "good"), str(tmp_path / "dead"), F.col("value") > 1)
    assert spark.read.parquet(str(tmp_path / "dead")).columns[-1] == "failed_at"
    sinks.register_run(spark, str(tmp_path / "runs"), "e1", "me", "cross", {"b": 2, "a": 1})
    assert spark.read.parquet(str(tmp_path / "runs")).first().parameters == "a=1;b=2"


def test_upsert(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "k int, v int")
    b = spark.createDataFrame([(2, 5), (2, 7), (3, 9)], "k int, v int")
    assert sorted(tuple(r) for r in sinks.upsert(a, b, ["k"], ["v"]).collect()) == [(1, 1), (2, 7), (3, 9)]


def test_registered_queries_have_stable_columns(spark, sf_dir):
    from barlake import plans

    assert set(plans.ORACLE) <= set(plans.QUERIES) and len(plans.QUERIES) > 100
    for name in ("flagship_cross_position", "rs8_ten_tick_bars", "tx6_capped_fills", "pf8_sqn"):
        df = plans.QUERIES[name](spark, sf_dir)
        assert df.count() > 0 and df.schema == plans.QUERIES[name](spark, sf_dir).schema


def test_stream_equals_batch(spark, sf_dir):
    from barlake.plans import QUERIES

    live = {tuple(r) for r in QUERIES["st2_live_bars"](spark, sf_dir).collect()}
    batch = {tuple(r) for r in QUERIES["rs1_hour_bars"](spark, sf_dir).collect()}
    assert live < batch and len(batch) - len(live) <= 12


# --- orders against the arrays of a day ----------------------------------------------------------


def brute_orders(orders, bars, impact, lot):
    touch, fill, slices = {}, [], []
    for oid, sid, at, size, limit, buy in orders:
        met = sorted([b for b in bars if b[0] == sid and at is not None and b[1].date() == at.date() and b[1] >= at], key=lambda b: b[1])
        hit = next((b for b in met if (b[4] is not None and b[4] <= limit if buy else b[3] is not None and b[3] >= limit)), None) if limit is not None else None
        touch[oid] = hit and (hit[1], min(hit[2], limit) if buy else max(hit[2], limit))
        left = size
        for b in met:
            n = min(left, math.floor((b[6] or 0.0) * impact))
            if n > 0:
                fill.append((oid, b[1], n, b[5]))
                left -= n
        whole, upto, seen = sum(b[6] or 0.0 for b in met), 0, 0.0
        for i, b in enumerate(met):
            seen += b[6] or 0.0
            to = size if i == len(met) - 1 else math.floor((seen / whole if whole else 0.0) * size / lot) * lot
            if to > upto:
                slices.append((oid, b[1], to - upto))
            upto = to
    return touch, sorted(fill), sorted(slices)


def test_orders_search_the_arrays_of_their_day(spark, monkeypatch):
    import numpy as np

    from barlake.operators import daybook

    monkeypatch.setattr(daybook, "ORDERS", 7)  # parts of a series and day
    rng = np.random.default_rng(5)
    bars, orders = [], []
    for sid in "ab":
        for day in (1, 2, 3):
            for m in sorted(rng.choice(300, 37, replace=False).tolist()):
                o, c = rng.integers(80, 120, 2).astype(float).tolist()
                low = None if rng.random() < 0.05 else min(o, c) - float(rng.integers(0, 4))
                bars.append((sid, T(f"2024-01-0{day} {9 + m // 60:02}:{m % 60:02}:00"), o, max(o, c) + 1, low, c, None if rng.random() < 0.1 else float(rng.integers(0, 60))))
    for i in range(150):
        at = T(f"2024-01-0{rng.integers(1, 5)} {rng.integers(8, 15):02}:{rng.integers(60):02}:00")
        orders.append((i, "abz"[int(rng.integers(3))], None if i == 9 else at, int(rng.integers(0, 200)), None if i % 31 == 3 else float(rng.integers(70, 130)), bool(rng.random() < 0.5)))
    b = spark.createDataFrame(bars, "sid string, ts timestamp, open double, high double, low double, close double, volume double").repartition(3)
    o = spark.createDataFrame(orders, "order_id long, sid string, created_dt timestamp, size long, pricelimit double, is_buy boolean")
    touch, fill, slices = brute_orders(orders, bars, 0.3, 10)
    assert {r.order_id: r.touch_ts and (r.touch_ts, r.touch_price) for r in execution.limit_touch(o, b).collect()} == touch
    assert sorted((r.order_id, r.executed_dt, r.executed_size, r.executed_price) for r in execution.capped_fills(o, b, 0.3).collect()) == fill
    assert sorted((r.order_id, r.bar_ts, r.target) for r in execution.vwap_schedule(o, b, 10).collect()) == slices and len(slices) > 300
    assert execution.capped_fills(o, b.limit(0)).count() == execution.vwap_schedule(o.limit(0), b).count() == 0


# --- ledgers that need the last step -------------------------------------------------------------


def test_ignored_sells_lower_nothing(spark):
    rows = [("2024-01-01 10:00:00", 10, 1.0, 0.0, True), ("2024-01-01 11:00:00", 5, 1.0, 0.0, False), ("2024-01-02 09:00:00", 11, 1.0, 0.0, False), ("2024-01-02 10:00:00", 4, 3.0, 0.0, True), ("2024-01-02 11:00:00", 10, 1.0, 0.0, False), ("2024-01-02 12:00:00", 1, 1.0, 0.0, False), ("2024-01-03 09:00:00", 4, 1.0, 0.0, False)]
    got = ledger.strict_ledger(fills(spark, rows)).orderBy("executed_dt").collect()
    assert [(r.ignored, r.size_after, r.available_after, r.cost_basis) for r in got] == [(False, 10, 0, 1.0), (True, 10, 0, 1.0), (True, 10, 10, 1.0), (False, 14, 10, 22 / 14), (False, 4, 0, 22 / 14), (True, 4, 0, 22 / 14), (False, 0, 0, None)]
    assert ledger.oversells(fills(spark, rows)).count() > 3  # the plain guard counts ignored sells against later ones


def actions(spark, rows, instruments=(), adjustments=(), rights=(), closes=()):
    made = spark.createDataFrame([("e", s, str(i), T(t), q, p, 0.0, b) for i, (s, t, q, p, b) in enumerate(rows)], FILL)
    return ledger.positions_through_events(
        made, spark.createDataFrame(list(adjustments), "sid string, day string, bonus_share double, transfer double, bonus double"), spark.createDataFrame(list(rights), "sid string, day string, ratio double, price double"),
        spark.createDataFrame(list(instruments), "sid string, delist string, merger string, ratio double"), spark.createDataFrame(list(closes), "sid string, day string, close double"),
    )


def test_positions_are_carried_through_events(spark):
    got = actions(
        spark, [("a", "2024-01-01", 10, 10.0, True), ("a", "2024-01-02", 10, 2.0, True), ("a", "2024-01-04", 31, 2.0, False), ("a", "2024-01-05", 5, 3.0, False)],
        adjustments=[("a", "2024-01-02", 4.0, 6.0, 5.0), ("z", "2024-01-02", 4.0, 6.0, 5.0)], rights=[("a", "2024-01-03", 1.0, 4.0)],
    ).orderBy("day", "action").collect()
    assert [(r.action, r.size_after, r.available_after, round(r.cost_basis, 6), r.cash) for r in got[:4]] == [
        ("fill", 10, 0, 10.0, -100.0), ("bonus", 20, 20, 5.0, 5.0), ("fill", 30, 20, 4.0, -20.0), ("rights", 33, 30, 4.0, -12.0)
    ]
    assert [(r.action, r.size_after) for r in got[-2:]] == [("fill", 2), ("ignored", 2)]


def test_chains_of_mergers(spark):
    ends = [("a", "2024-01-02", "b", 0.5), ("b", "2024-01-02", "c", 2.0), ("c", "2024-02-01", "d", 1.0), ("d", "2024-03-01", None, None), ("x", "2024-01-02", "0", 1.0)]
    rows = [("a", "2024-01-01", 11, 4.0, True), ("c", "2024-01-01", 10, 1.0, True), ("x", "2024-01-01", 3, 1.0, True), ("y", "2024-01-01", 3, 1.0, True), ("d", "2024-02-02", 20, 9.0, False)]
    got = actions(spark, rows, ends, closes=[("a", "2023-12-30", 6.0), ("a", "2024-01-05", 99.0), ("b", "2024-01-02", 8.0), ("c", "2024-02-01", 5.0)]).orderBy("day", "sid").collect()
    seen = [(r.sid, r.action, r.size_after, r.cost_basis) for r in got if r.action not in ("fill", "ignored")]
    assert sorted(seen[:5]) == [("a", "ended", 0, None), ("b", "ended", 0, None), ("b", "merged", 5, 12.0), ("c", "merged", 20, 2.5), ("x", "ended", 0, None)]
    assert sorted(seen[5:]) == [("c", "ended", 0, None), ("d", "merged", 20, 5.0)]  # all sold before the last day of d
    assert [(r.size_after, r.cash) for r in got if r.sid == "d" and r.action == "fill"] == [(0, 180.0)]
    families = {r.sid: (r.family, r.steps) for r in ledger.merger_families(spark.createDataFrame(ends, "sid string, delist string, merger string, ratio double")).collect()}
    assert families == {"a": ("d", 3), "b": ("d", 2), "c": ("d", 1)}


@pytest.mark.parametrize("circle", ["ab", "abc", "abcde"])
def test_mergers_in_a_circle_are_an_error(spark, circle):
    ends = [(s, "2024-01-02", circle[(i + 1) % len(circle)], 1.0) for i, s in enumerate(circle)]
    with pytest.raises(ValueError, match="circle"):
        ledger.merger_families(spark.createDataFrame(ends, "sid string, delist string, merger string, ratio double"))
