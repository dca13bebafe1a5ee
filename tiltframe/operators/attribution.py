"""Additive attributions of a score to its features."""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import combinations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.operators.scorers import Scorer

#: Features whose subsets are all scored, at most.
MOST_EXACT = 12


def _as_column(features: Sequence[str]):
    return F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"__phi_{f}").alias("attribution"))
            for f in features
        ]
    ).alias("attributions")


def linear_attribution(
    df: DataFrame, weights: dict[str, float], means: dict[str, float], keep: Sequence[str]
) -> DataFrame:
    """weight x (value - mean) per feature, exact for a linear score."""
    phi = {f"__phi_{f}": F.lit(w) * (F.col(f) - F.lit(means[f])) for f, w in weights.items()}
    return df.withColumns(phi).select(*keep, _as_column(list(weights)))


def permutation_attribution(
    df: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    background: dict[str, float],
    keep: Sequence[str],
    permutations: int = 8,
    seed: int = 7,
) -> DataFrame:
    """Shapley values over sampled feature orders: features switch one by one from the
    background to the row's value, each switch credits its feature with the change in score.
    All coalitions of a row are variants of that row; the values sum to score - background score.
    """
    rng = random.Random(seed)
    orders = [rng.sample(list(features), len(features)) for _ in range(permutations)]
    names: dict[frozenset, str] = {}
    for order in orders:
        for i in range(len(order) + 1):
            names.setdefault(frozenset(order[:i]), f"__coalition_{len(names)}")
    variants = {
        name: {f: F.col(f) if f in members else F.lit(background[f]) for f in features}
        for members, name in names.items()
    }
    scored = scorer.add_scores(df, variants)
    gains = {f: [] for f in features}
    for order in orders:
        for i, f in enumerate(order):
            after, before = names[frozenset(order[: i + 1])], names[frozenset(order[:i])]
            gains[f].append(F.col(after) - F.col(before))
    phi = {
        f"__phi_{f}": sum(g[1:], g[0]) / F.lit(float(permutations)) for f, g in gains.items()
    }
    return scored.withColumns(phi).select(*keep, _as_column(features))


def coalition_attribution(
    df: DataFrame, scorer: Scorer, features: Sequence[str], background: dict[str, float], keep: Sequence[str]
) -> DataFrame:
    """Exact Shapley values. Every subset of the features, taken from the row while the others keep the
    background's values, is one variant of the row and scored once; a feature is credited with its gain
    over each subset without it, weighted by the share of feature orders that begin with that subset.
    There are 2 ** d variants, so this is for some ten features; sampled orders are for more.
    """
    d = len(features)
    if d > MOST_EXACT:
        raise ValueError(f"{d} features have {2**d} subsets; sample orders with permutation_attribution")
    names = {frozenset(s): f"__subset_{sum(1 << i for i in s)}" for n in range(d + 1) for s in combinations(range(d), n)}
    variants = {
        name: {f: F.col(f) if i in members else F.lit(background[f]) for i, f in enumerate(features)}
        for members, name in names.items()
    }
    scored = scorer.add_scores(df, variants)
    phi = {}
    for i, f in enumerate(features):
        credit = F.lit(0.0)
        for members, name in names.items():
            if i not in members:
                share = factorial(len(members)) * factorial(d - len(members) - 1) / factorial(d)
                credit = credit + F.lit(share) * (F.col(names[members | {i}]) - F.col(name))
        phi[f"__phi_{f}"] = credit
    return scored.withColumns(phi).select(*keep, _as_column(features))


def mean_abs_attribution(attributions: DataFrame, label: str = "label") -> DataFrame:
    """Mean absolute attribution per label and feature."""
    rows = attributions.select(label, F.inline_outer("attributions"))
    return rows.groupBy(label, "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
