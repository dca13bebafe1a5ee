"""Rank-biased overlap of two ranked lists as array expressions.

An item that both lists hold by depth r (the larger of its two ranks) adds w_d/d at every depth
d >= r, so the overlap is a sum over common items of a difference of two prefix sums of w_d/d.
The prefix sums only depend on p: the first ``TABLED`` are literals, deeper ones add the weights
beyond. Lists may be of any length; nothing leaves the row. A null list has a null overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiltframe.functions.scalar import add_all, literal_array


TABLED = 100


def _prefix_sum(p: float) -> Callable[[Column], Column]:
    """The sum of w_i/i for i = 1 to d."""
    total, table = 0.0, [0.0]
    for d in range(1, TABLED + 1):
        total += 1.0 / d if p == 1.0 else (1.0 - p) * p ** (d - 1) / d
        table.append(total)
    literal = literal_array(table)

    def weight(i: Column) -> Column:
        return 1.0 / i if p == 1.0 else (1.0 - p) * F.pow(F.lit(p), i - 1) / i

    def upto(d: Column) -> Column:
        beyond = F.when(d > TABLED, F.sequence(F.lit(TABLED + 1), F.greatest(d, F.lit(TABLED + 1))))
        deep = F.coalesce(add_all(beyond, weight), F.lit(0.0))
        return F.element_at(literal, F.least(d, F.lit(TABLED)) + 1) + deep

    return upto


def _check_p(p: float, allow_one: bool) -> None:
    if not (0.0 < p < 1.0 or (allow_one and p == 1.0)):
        raise ValueError(f"p out of range: {p}")


def _common_depths(s: Column, t: Column) -> Column:
    """Depth by which both lists hold an item, for every common item."""
    depths = F.transform(
        s,
        lambda x, i: F.when(
            F.array_position(t, x) > 0, F.greatest(F.array_position(t, x), i.cast("bigint") + 1)
        ).cast("int"),
    )
    return F.filter(depths, lambda r: r.isNotNull())


def _bounded(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def _guarded(s: Column, t: Column, value: Column, check: bool) -> Column:
    out = (
        F.when(s.isNull() | t.isNull(), F.lit(None).cast("double"))
        .when((F.size(s) == 0) & (F.size(t) == 0), F.lit(1.0))
        .when((F.size(s) == 0) | (F.size(t) == 0), F.lit(0.0))
        .otherwise(_bounded(value))
    )
    if check:
        repeated = (F.size(F.array_distinct(s)) < F.size(s)) | (
            F.size(F.array_distinct(t)) < F.size(t)
        )
        out = F.when(repeated, F.raise_error(F.lit("ranked list holds an item twice"))).otherwise(out)
    return out


def rank_biased_overlap(
    s: Column,
    t: Column,
    p: float = 1.0,
    k: int | None = None,
    ext: bool = False,
    check: bool = True,
) -> Column:
    """Overlap down to depth min(|S|, |T|, k); p = 1 is the average overlap.

    ``ext`` adds the agreement at the last depth times p^k.
    """
    _check_p(p, allow_one=True)
    depth = F.least(F.size(s), F.size(t), *([F.lit(k)] if k is not None else []))
    upto = _prefix_sum(p)
    within = F.filter(_common_depths(s, t), lambda r: r <= depth)
    total = add_all(within, lambda r: upto(depth) - upto(r - 1))
    if p == 1.0:
        total = total / F.greatest(depth, F.lit(1))
    elif ext:
        total = total + F.size(within) / F.greatest(depth, F.lit(1)) * F.pow(F.lit(p), depth)
    return _guarded(s, t, total, check)


def average_overlap(s: Column, t: Column, k: int | None = None, **kw) -> Column:
    return rank_biased_overlap(s, t, p=1.0, k=k, **kw)


def rank_biased_overlap_uneven(
    s: Column, t: Column, p: float = 0.98, check: bool = True
) -> Column:
    """Extrapolated overlap of lists of different length."""
    _check_p(p, allow_one=False)
    one = F.lit(1)
    short = F.greatest(F.least(F.size(s), F.size(t)), one)
    long = F.greatest(F.size(s), F.size(t), one)
    upto = _prefix_sum(p)
    power = lambda d: F.pow(F.lit(p), d)
    depths = _common_depths(s, t)
    x_long = F.size(depths).cast("double")
    x_short = F.size(F.filter(depths, lambda r: r <= short)).cast("double")
    seen = add_all(depths, lambda r: upto(long) - upto(r - 1))
    unseen = x_short / short * (power(short) - power(long) - short * (upto(long) - upto(short)))
    beyond = ((x_long - x_short) / long + x_short / short) * power(long)
    return _guarded(s, t, seen + unseen + beyond, check)


def top_weight(p: Column, depth: Column) -> Column:
    """Share of the total weight held by the first ``depth`` ranks."""
    d = depth.cast("int")
    scale = (1.0 - p) / p
    log_term = F.log(1.0 / (1.0 - p))
    head = F.when(
        d >= 2,
        add_all(F.sequence(F.lit(1), F.greatest(d - 1, F.lit(1))), lambda i: F.pow(p, i) / i),
    )
    value = (
        F.when(d <= 0, F.lit(1.0))
        .when(d == 1, scale * log_term)
        .otherwise(1.0 - F.pow(p, d - 1) + scale * d * (log_term - head))
    )
    return _bounded(value)
