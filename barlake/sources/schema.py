"""Schemas of the tables that operators take and give."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


S, D, L, TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()
BARS = _of(sid=S, ts=TS, open=D, high=D, low=D, close=D, volume=D, amount=D)
TICKS = _of(sid=S, ts=TS, price=D, volume=D, amount=D)
ORDERS = _of(experiment_id=S, sid=S, order_id=S, size=L, sizer_ratio=D, price=D, pricelimit=D, is_buy=T.BooleanType(), exec_type=T.IntegerType(), created_dt=TS)
FILLS = _of(experiment_id=S, sid=S, order_id=S, executed_dt=TS, executed_size=L, executed_price=D, comm=D, is_buy=T.BooleanType())
POSITIONS = _of(experiment_id=S, sid=S, datetime=TS, created_dt=TS, size=L, available=L, cost_basis=D, pnl=D)
ACCOUNTS = _of(experiment_id=S, datetime=TS, portfolio_value=D, cash=D, pnl=D, leverage=D, margin=D)
METRICS = _of(ts=TS, metric=S, value=D)
PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume", "amount")
