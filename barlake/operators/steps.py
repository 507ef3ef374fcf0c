"""Step machines: what one row of a series does to what the rows before left behind.

One machine serves tables and streams: ``stepwise`` runs it over sorted rows of
a series, ``streaming.live.live_steps`` over rows that the watermark has passed.
All that a machine carries is ``state``, a list of plain values (numbers, text,
lists, None) that JSON can hold; a call takes a row as a dict and gives the rows
it puts out, as tuples of ``columns``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import types as T

from ..functions.exprs import TINY

DOUBLE, LONG, INT = (T.DoubleType(), pa.float64()), (T.LongType(), pa.int64()), (T.IntegerType(), pa.int32())
BOOL, TEXT = (T.BooleanType(), pa.bool_()), (T.StringType(), pa.string())


def known(x: object) -> bool:
    """Neither null nor NaN."""
    return x is not None and x == x


def nearest(x: float) -> int:
    """The nearest whole number; halves go away from zero, as in SQL."""
    whole = math.trunc(x)
    return whole if abs(x - whole) < 0.5 else whole + (1 if x > 0 else -1)


class Step:
    """A machine; subclasses name their inputs and columns and set ``state`` to that of a new series."""

    inputs: Sequence[str] = ()
    columns: Sequence[tuple[str, tuple[T.DataType, pa.DataType]]] = ()
    state: list

    def __call__(self, row: dict) -> list[tuple]:
        raise NotImplementedError


Make = Callable[[], Step]


class Average(Step):
    """The exponential average (k = 2 / (n + 1), or 1 / n) that begins with the mean of n known values."""

    def __init__(self, n: int = 14, wilder: bool = False, x: str = "close", name: str = "average"):
        self.n, self.k, self.x = n, 1.0 / n if wilder else 2.0 / (n + 1), x
        self.inputs, self.columns = (x,), ((x, DOUBLE), (name, DOUBLE))
        self.state = [0, 0.0, None]

    def __call__(self, row: dict) -> list[tuple]:
        count, total, value = self.state
        x = row[self.x]
        if known(x):
            count, total = count + 1, total + x
            value = None if count < self.n else total / self.n if count == self.n else (1 - self.k) * value + self.k * x
            self.state = [count, total, value]
        return [(x, value)]


class Kaufman(Step):
    """The average whose step follows the efficiency ratio of the last n moves; the last n values are its state.

    Rows are counted with their nulls, as in the batch operator: row n begins
    with the mean of the known values, and a row without a ratio carries on.
    """

    def __init__(self, n: int = 30, fast: int = 2, slow: int = 30, x: str = "close", name: str = "kama"):
        self.n, self.fast, self.slow, self.x = n, 2.0 / (fast + 1), 2.0 / (slow + 1), x
        self.inputs, self.columns = (x,), ((x, DOUBLE), (name, DOUBLE))
        self.state = [0, [], None]

    def __call__(self, row: dict) -> list[tuple]:
        count, ring, value = self.state
        x = row[self.x] if known(row[self.x]) else None
        count, values = count + 1, [*ring, x]
        if count == self.n:
            seeds = [v for v in values if v is not None]
            value = sum(seeds) / len(seeds) if seeds else None
        elif count > self.n and x is not None and values[0] is not None:
            moves = [abs(b - a) for a, b in zip(values, values[1:]) if a is not None and b is not None]  # noqa: B905
            path, way = sum(moves), abs(x - values[0])
            ratio = 0.0 if path < TINY else way / path
            smooth = (ratio * (self.fast - self.slow) + self.slow) ** 2
            value = None if value is None else (1 - smooth) * value + smooth * x
        self.state = [count, values[-self.n :], value]
        return [(x, value)]


class Renko(Step):
    """Bricks on a ladder of levels one size apart around the first open (see ``fill.renko``); the band is its state."""

    columns = tuple((c, DOUBLE) for c in ("open", "high", "low", "close", "volume"))
    inputs = ("open", "high", "low", "close")

    def __init__(self, size: float | None = None, autosize: float = 20.0, align: float = 1.0, hilo: bool = False, dynamic: bool = False, round_start: bool = True):
        self.size, self.autosize, self.align, self.hilo, self.dynamic, self.round_start = size, autosize, align, hilo, dynamic, round_start
        self.state = [None, None, None]

    def __call__(self, row: dict) -> list[tuple]:
        low, high, height = self.state
        close = row["close"]
        if not known(close):
            return []
        if low is None:
            if not known(row["open"]):
                return []
            origin = nearest(row["open"] / self.align) * self.align
            height = self.size or float(origin // self.autosize)
            origin = int(origin) if self.round_start else origin
            low, high = origin - height, origin + height
            self.state = [low, high, height]
        way = 1 if row["high" if self.hilo else "close"] >= high else -1 if row["low" if self.hilo else "close"] <= low else 0
        if not way:
            return []
        begin = high if way > 0 else low
        end = begin + way * height
        if self.dynamic and self.size is None:
            height = float(close // self.autosize)
            end = round((begin + way * height) / self.align) * self.align
        low, high = min(begin, end), max(begin, end)
        self.state = [low, high, height]
        return [(float(begin), float(high), float(low), float(end), 0.0)]


class ArmedStop(Step):
    """A position that an entry opens while flat and a close below its trailing stop ends."""

    columns = (("position", INT), ("stop", DOUBLE))

    def __init__(self, enter: str, distance: str):
        self.enter, self.distance, self.inputs = enter, distance, (enter, distance, "close")
        self.state = [None]

    def __call__(self, row: dict) -> list[tuple]:
        (stop,) = self.state
        close, gap = row["close"], row[self.distance]
        if stop is not None and known(close):
            stop = None if close < stop else max(stop, close - gap) if known(gap) else stop
        elif stop is None and row[self.enter] and known(close) and known(gap):
            stop = close - gap
        self.state = [stop]
        return [(int(stop is not None), stop)]


class CarriedSlice(Step):
    """Slices that accumulate until they are worth ``least``; the last one takes what is left."""

    columns = (("target", LONG), ("bar_close", DOUBLE))
    inputs = ("target", "bar_close", "_last")

    def __init__(self, least: float):
        self.least, self.state = least, [0]

    def __call__(self, row: dict) -> list[tuple]:
        held = self.state[0] + row["target"]
        if not row["_last"] and held * row["bar_close"] < self.least:
            self.state = [held]
            return []
        self.state = [0]
        return [(held, row["bar_close"])] if held > 0 else []


class StrictHolding(Step):
    """A position that ignores sells of more than is available (see ``ledger.strict_ledger``)."""

    columns = (("ignored", BOOL), ("size_after", LONG), ("available_after", LONG), ("cost_basis", DOUBLE))
    inputs = ("_day", "is_buy", "executed_size", "executed_price")

    def __init__(self):
        self.state = [None, 0, 0, None]

    def __call__(self, row: dict) -> list[tuple]:
        day, size, available, cost = self.state
        if row["_day"] != day:
            day, available = row["_day"], size
        n, ignored = row["executed_size"], False
        if row["is_buy"]:
            if n:
                cost = row["executed_price"] if not size else (cost * size + row["executed_price"] * n) / (size + n)
            size += n
        elif n > available:
            ignored = True
        else:
            size, available = size - n, available - n
        cost = cost if size else None
        self.state = [day, size, available, cost]
        return [(ignored, size, available, cost)]


class EventHolding(Step):
    """Positions of a family of series, tied by mergers, through fills and corporate actions (see ``ledger.positions_through_events``)."""

    inputs = ("_day", "_kind", "sid", "is_buy", "executed_size", "executed_price", "_grow", "_paid", "_price", "_to")

    def __init__(self, sid: tuple[T.DataType, pa.DataType], strict: bool = True):
        self.columns = (("sid", sid), ("action", TEXT), ("size_after", LONG), ("available_after", LONG), ("cost_basis", DOUBLE), ("cash", DOUBLE))
        self.strict, self._day, self._held = strict, None, {}

    @property
    def state(self) -> list:
        return [self._day, [[sid, *x] for sid, x in self._held.items()]]

    @state.setter
    def state(self, state: list) -> None:
        self._day, self._held = state[0], {sid: x for sid, *x in state[1]}

    def _hold(self, sid: object, size: int, available: int, cost: float | None) -> None:
        if size:
            self._held[sid] = [size, available, cost]
        else:
            self._held.pop(sid, None)

    def __call__(self, row: dict) -> list[tuple]:
        held, sid, kind = self._held, row["sid"], row["_kind"]
        if row["_day"] != self._day:
            self._day = row["_day"]
            for x in held.values():
                x[1] = x[0]
        size, available, cost = held.get(sid, (0, 0, None))
        cash, merged = 0.0, []
        if kind == "fill":
            n, price = row["executed_size"], row["executed_price"]
            if row["is_buy"]:
                cost = (price if size <= 0 else (cost * size + price * n) / (size + n)) if n else cost
                size, cash = size + n, -price * n
            elif self.strict and n > available:
                kind = "ignored"
            else:
                size, available, cash = size - n, available - n, price * n
        elif not size:
            return []
        elif kind == "bonus":
            cash = size * row["_paid"]
            size, available, cost = int(size * row["_grow"]), int(available * row["_grow"]), cost / row["_grow"]
        elif kind == "rights":
            ratio = row["_paid"]
            cash = -size * ratio * row["_price"]
            size, cost = int(size * row["_grow"]), (cost + ratio * row["_price"]) / row["_grow"]
        else:  # a series' last day
            to, ratio = row["_to"], row["_grow"]
            moved = 0 if to is None else int(size * ratio)
            if moved:
                price = row["_price"] / ratio if known(row["_price"]) else cost / ratio
                other, free, paid = held.get(to, (0, 0, None))
                paid = (other * (paid or 0.0) + moved * price) / (other + moved) if other + moved else None
                self._hold(to, other + moved, free + moved, paid)
                merged = [(to, "merged", other + moved, free + moved, paid, 0.0)]
            size, available = 0, 0
        cost = cost if size else None
        self._hold(sid, size, available, cost)
        return [(sid, kind, size, available, cost, cash), *merged]
