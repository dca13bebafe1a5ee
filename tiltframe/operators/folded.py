"""Linear models fitted for all folds at once: logistic regression, squared hinge, sigmoid calibration.

Model i of k learns from all rows but those of fold i; one more model learns from every row. Each
pass over the rows gives the gradients and curvatures of all models as one sum of matrices, so a
cross-validation takes as many passes as a single fit: about eight steps of Newton's method, instead of
k fits of many steps each.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltframe.functions.scalar import mean_of
from tiltframe.functions.sums import matrix_sums
from tiltframe.operators.scorers import Variants

LABEL = "label"
MAX_STEPS = 60


class Line(NamedTuple):
    coefficients: list[float]
    intercept: float


class LinearLogistic:
    """sigmoid(weights . features + intercept) as a Column expression. With several models, the row's
    ``fold`` chooses the one that did not see it."""

    def __init__(self, weights: np.ndarray, features: Sequence[str], fold: str | None = None):
        self.weights, self.features, self.fold = np.atleast_2d(weights), list(features), fold

    @property
    def model(self) -> Line:
        """The last model, which has learned from all rows."""
        return Line(self.weights[-1, :-1].tolist(), float(self.weights[-1, -1]))

    def _weight(self, j: int) -> Column:
        values = [F.lit(float(w)) for w in self.weights[:, j]]
        return values[0] if self.fold is None else F.get(F.array(*values), F.col(self.fold))

    def margin(self, values: dict[str, Column]) -> Column:
        out = self._weight(len(self.features))
        for j, f in enumerate(self.features):
            out = out + self._weight(j) * values[f]
        return out

    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        return df.withColumns({name: 1.0 / (1.0 + F.exp(-self.margin(values))) for name, values in variants.items()})


class CalibratedMargins:
    """The mean over folds of sigmoid(slope * margin + intercept), each fold with its own line."""

    def __init__(self, weights: np.ndarray, sigmoids: np.ndarray, features: Sequence[str]):
        self.members = [LinearLogistic(w, features) for w in weights]
        self.sigmoids = sigmoids

    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        def probability(values: dict[str, Column]) -> Column:
            parts = [
                1.0 / (1.0 + F.exp(-(F.lit(float(a)) * m.margin(values) + F.lit(float(b)))))
                for m, (a, b) in zip(self.members, self.sigmoids, strict=True)
            ]
            return mean_of(parts)

        return df.withColumns({name: probability(values) for name, values in variants.items()})


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature in the margin."""
    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    return np.logaddexp(0, margin) - y * margin, p - y, p * (1 - p)


def _squared_hinge(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sign = 2 * y - 1
    short = np.maximum(0, 1 - sign * margin)
    return short**2, -2 * sign * short, 2.0 * (short > 0)


LOSSES = {"logistic": _logistic, "squared_hinge": _squared_hinge}


def _model_parts(weights: np.ndarray, class_weights: np.ndarray, learns: np.ndarray, loss: str, targets: np.ndarray):
    """A function of a block of rows (features, label, fold): per model the loss, the gradient and the
    curvature of the weighted loss over the rows that it learns from."""
    k, d = weights.shape

    def part(block: np.ndarray) -> np.ndarray:
        x = np.column_stack((block[:, : d - 1], np.ones(len(block))))
        label, fold = block[:, d - 1].astype(np.int64), np.minimum(block[:, d], learns.shape[1] - 1).astype(np.int64)
        use = class_weights.T[label] * learns.T[fold]
        value, slope, bend = LOSSES[loss](x @ weights.T, targets.T[label])
        curvature = np.einsum("nk,ni,nj->kij", use * bend, x, x, optimize=True)
        return np.column_stack(((use * value).sum(0), (use * slope).T @ x, curvature.reshape(k, d * d)))

    return part


def class_counts(df: DataFrame, fold: str, folds: int) -> np.ndarray:
    """Rows of each fold (a last place: those of no fold) and class."""
    by = np.zeros((folds + 1, 2))
    for r in df.groupBy(fold, LABEL).agg(F.count("*").alias("n")).collect():
        if r[LABEL] not in (0, 1):
            raise ValueError(f"{LABEL} is {r[LABEL]!r} in some rows; only 0 and 1 can be learned")
        by[min(r[fold], folds), int(r[LABEL])] += r["n"]
    return by


def _outside(folds: int) -> np.ndarray:
    """Which folds (second place) each model learns from: all but its own; the last one from all."""
    return np.vstack((1 - np.eye(folds, folds + 1), np.ones(folds + 1)))


def _class_weights(counts: np.ndarray, balanced: bool) -> np.ndarray:
    return counts.sum(1, keepdims=True) / (2 * counts) if balanced else np.ones_like(counts)


def _newton(df: DataFrame, columns: Sequence[str], each, learns, loss: str, targets, strength: float) -> np.ndarray:
    """The weights of each model at its least loss, all models side by side."""
    k, d = len(learns), len(columns) - 1
    penalty = np.append(np.full(d - 1, strength), 0.0)
    weights, best, value = np.zeros((k, d)), np.zeros((k, d)), np.full(k, np.inf)
    settled = np.zeros(k, bool)
    for _ in range(MAX_STEPS):
        sums = matrix_sums(df, columns, _model_parts(weights, each, learns, loss, targets))
        if not np.isfinite(sums).all():
            raise ValueError("some features are null or not finite")
        for i in np.flatnonzero(~settled):
            total = sums[i, 0] + 0.5 * (penalty * weights[i] ** 2).sum()
            if total > value[i] + 1e-9 * abs(value[i]):
                # Too far: half of the way.
                weights[i] = (weights[i] + best[i]) / 2
                continue
            value[i], best[i] = total, weights[i]
            gradient = sums[i, 1 : d + 1] + penalty * weights[i]
            curvature = sums[i, d + 1 :].reshape(d, d) + np.diag(penalty)
            step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            weights[i] = weights[i] - step
            settled[i] = np.abs(step).max() <= 1e-11 * (1 + np.abs(weights[i]).max())
        if settled.all():
            return weights
    raise RuntimeError(f"the fit did not settle in {MAX_STEPS} steps")


def fit_folds(
    df: DataFrame,
    features: Sequence[str],
    fold: str,
    folds: int,
    c: float = 1.0,
    balanced: bool = False,
    loss: str = "logistic",
) -> np.ndarray:
    """Weights and intercept of each model, one row per fold and a last one over all rows, at the least
    summed loss plus half the squared weights over ``c``; ``balanced`` weighs the classes of each model
    alike."""
    learns = _outside(folds)
    counts = learns @ class_counts(df, fold, folds)
    poor = [i for i in range(len(counts)) if not counts[i].all()]
    if poor:
        raise ValueError(f"the rows outside of fold {poor[0]} are all of one class")
    targets = np.tile([0.0, 1.0], (folds + 1, 1))
    return _newton(df, [*features, LABEL, fold], _class_weights(counts, balanced), learns, loss, targets, 1.0 / c)


def fit_sigmoids(df: DataFrame, raw: str, fold: str, folds: int) -> np.ndarray:
    """Slope and intercept of each fold's sigmoid over the raw scores of its own rows, all in one go. The
    targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2) instead of 1 and 0, so that it stays finite."""
    counts = class_counts(df, fold, folds)[:folds]
    targets = np.column_stack((1 / (counts[:, 0] + 2), (counts[:, 1] + 1) / (counts[:, 1] + 2)))
    return _newton(df, [raw, LABEL, fold], np.ones((folds, 2)), np.eye(folds, folds + 1), "logistic", targets, 0.0)


def residuals(
    df: DataFrame, features: Sequence[str], fold: str, weights: np.ndarray, c: float = 1.0, balanced: bool = False
) -> np.ndarray:
    """The gradient of each model's objective at ``weights``, in one pass: 0 at the optimum."""
    folds, d = weights.shape[0] - 1, weights.shape[1]
    learns = _outside(folds)
    each = _class_weights(learns @ class_counts(df, fold, folds), balanced)
    targets = np.tile([0.0, 1.0], (folds + 1, 1))
    sums = matrix_sums(df, [*features, LABEL, fold], _model_parts(weights, each, learns, "logistic", targets))
    return sums[:, 1 : d + 1] + weights * np.append(np.full(d - 1, 1.0 / c), 0.0)


def folded_scores(
    df: DataFrame, features: Sequence[str], fold: str = "fold", folds: int = 5, c: float = 1.0, balanced: bool = False
) -> DataFrame:
    """With ``prob``: each row's probability by the model that did not see its fold."""
    weights = fit_folds(df, features, fold, folds, c, balanced)[:folds]
    scorer = LinearLogistic(weights, features, fold)
    return scorer.add_scores(df, {"prob": {f: F.col(f) for f in features}})
