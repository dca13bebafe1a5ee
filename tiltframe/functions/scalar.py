"""Small Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def base2_logit(prob: Column, eps: float = 1e-16) -> Column:
    """log2 of the odds, kept finite at 0 and 1 by ``eps``."""
    return F.log2((prob + F.lit(eps)) / (F.lit(1.0) - prob + F.lit(eps)))


def hours(n: int | Column) -> Column:
    """An interval of ``n`` hours."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def elapsed_hours(start: Column, end: Column) -> Column:
    """Fractional hours from start to end."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def mean_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols)))


def literal_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def add_all(items: Column, of=lambda x: x) -> Column:
    """Sum of ``of(item)`` over an array column."""
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + of(x))
