"""Element-wise logic of lines: arithmetic with a safe divisor, comparisons, choices, folds.

Comparisons and conditions give 1.0 or 0.0, null where an operand is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F

from .windows import BY, ORDER, series, trailing

#: A divisor nearer to zero than this makes the quotient zero.
TINY = 1e-8


def num(condition: Column) -> Column:
    """A truth value as 1.0 or 0.0."""
    return condition.cast("double")


def divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is about zero."""
    return F.when(F.abs(b) < TINY, F.when(a.isNotNull(), 0.0)).otherwise(a / b)


def floor_divide(a: Column, b: Column) -> Column:
    """floor(a / b), 0 where b is about zero."""
    return F.floor(divide(a, b)).cast("double")


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def absolute(a: Column) -> Column:
    return F.abs(a)


def truth(a: Column) -> Column:
    """1.0 where a is not zero."""
    return num(a != 0)


def compare(a: Column, op: str, b: Column) -> Column:
    """a op b for < > <= >= == != as 1.0 or 0.0."""
    ops = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b}
    return num(ops[op])


def time_compare(ts: Column, op: str, time: str) -> Column:
    """Compares the time of day of ``ts`` with HH:MM:SS."""
    return compare(F.date_format(ts, "HH:mm:ss"), op, F.lit(time))


def delay(a: Column, k: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """The value k bars ago; a negative k looks k bars ahead (for labels, not causal)."""
    w = series(by, order)
    return F.lag(a, k).over(w) if k >= 0 else F.lead(a, -k).over(w)


def forward(a: Column, k: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """The value k bars ahead."""
    return delay(a, -k, by, order)


def last_values(a: Column, size: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """The last ``size`` values, oldest first (fewer at the start)."""
    return F.collect_list(a).over(trailing(size, by, order))


def div_by_zero(a: Column, b: Column, zero: float = 0.0) -> Column:
    """a / b, or ``zero`` where b is 0."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(a, b), F.lit(zero)))


def div_zero_by_zero(a: Column, b: Column, single: float = inf, dual: float = 0.0) -> Column:
    """a / b; ``dual`` for 0 / 0 and ``single`` for x / 0."""
    return F.when((a == 0) & (b == 0), F.lit(dual)).when((b == 0) & a.isNotNull(), F.lit(single)).otherwise(F.try_divide(a, b))


def cmp(a: Column, b: Column) -> Column:
    return a - b


def cmp_ex(a: Column, b: Column, less: Column, equal: Column, greater: Column) -> Column:
    """One of three values by the order of a and b."""
    return F.when(a < b, less).when(a == b, equal).when(a > b, greater)


def choose(condition: Column, a: Column, b: Column) -> Column:
    """a where the condition is not zero, else b."""
    return F.when(condition != 0, a).otherwise(b)


def all_of(*lines: Column) -> Column:
    return num(reduce(lambda x, y: x & y, [c != 0 for c in lines]))


def any_of(*lines: Column) -> Column:
    return num(reduce(lambda x, y: x | y, [c != 0 for c in lines]))


def max_of(*lines: Column) -> Column:
    return F.greatest(*lines)


def min_of(*lines: Column) -> Column:
    return F.least(*lines)


def sum_of(*lines: Column) -> Column:
    return reduce(lambda x, y: x + y, lines)


def fold(step: Callable[[Column, Column], Column], *lines: Column, start: Column | None = None) -> Column:
    """Folds a row's lines from the left with ``step``."""
    first, rest = (lines[0], lines[1:]) if start is None else (start, lines)
    return F.aggregate(F.array(*rest), first, step)
