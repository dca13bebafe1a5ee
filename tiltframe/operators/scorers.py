"""Risk models as row-local scorers, ensemble votes and class decisions.

A scorer adds probability columns for several variants of the same row (the original and each
perturbed copy). Variants stay side by side in one row: nothing is exploded or shuffled to score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltframe.functions.scalar import mean_of

Variants = dict[str, dict[str, Column]]


class Scorer(Protocol):
    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        """Add one probability column per variant; a variant maps feature name to Column."""


class ColumnScorer:
    """A probability written as a Column expression of the features; runs inside codegen."""

    def __init__(self, formula: Callable[[dict[str, Column]], Column]):
        self.formula = formula

    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        return df.withColumns({name: self.formula(values) for name, values in variants.items()})


def _raw_to_probability(model) -> str:
    """Output column to read: the probability, or the plain prediction when there is none."""
    return "probability" if model.hasParam("probabilityCol") else "prediction"


class MLScorer:
    """A fitted ``pyspark.ml`` classifier over a declared feature order."""

    def __init__(self, model, features: Sequence[str]):
        self.model = model
        self.features = list(features)
        self.output = _raw_to_probability(model)

    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        for name, values in variants.items():
            vector, out = f"__{name}_vector", f"__{name}_out"
            scratch = {self.model.featuresCol: vector}
            for param in ("rawPredictionCol", "probabilityCol", "predictionCol"):
                if self.model.hasParam(param):
                    scratch[self.model.getParam(param)] = ""
            target = self.model.getParam(f"{self.output}Col")
            scratch[target] = out
            packed = F.array(*[values[f].cast("double") for f in self.features])
            df = self.model.transform(df.withColumn(vector, array_to_vector(packed)), scratch)
            value = F.col(out)
            if self.output == "probability":
                value = F.get(vector_to_array(value), 1)
            df = df.withColumn(name, value.cast("double")).drop(vector, out)
        return df


def bin_number(value: Column, edges: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted ``edges`` are not above ``value``, from ``first``; null stays null."""
    if not edges:
        return F.when(value.isNotNull(), F.lit(float(first)))
    mid = len(edges) // 2
    below, above = bin_number(value, edges[:mid], first), bin_number(value, edges[mid + 1 :], first + mid + 1)
    return F.when(value < F.lit(float(edges[mid])), below).otherwise(above)


class BinnedScorer:
    """A scorer fitted on bin numbers, for rows with the features themselves."""

    def __init__(self, scorer: Scorer, edges: dict[str, Sequence[float]]):
        self.scorer, self.edges = scorer, edges

    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        binned = {
            name: {f: bin_number(values[f], edges) for f, edges in self.edges.items()}
            for name, values in variants.items()
        }
        return self.scorer.add_scores(df, binned)


class BatchScorer:
    """Any Python model: ``predict(pandas.DataFrame) -> probabilities``.

    All variants of a batch of rows are scored in one call: a row is sent once, with its features and
    the values that variants change, and an array of probabilities comes back.
    """

    def __init__(self, predict: Callable[[pd.DataFrame], Sequence[float]], features: Sequence[str]):
        self.predict = predict
        self.features = list(features)

    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        predict, features = self.predict, self.features
        sent: dict[int, Column] = {}
        # Variants share the Column objects of the features that they leave alone.
        for values in variants.values():
            for f in features:
                sent.setdefault(id(values[f]), values[f])
        place = {key: i for i, key in enumerate(sent)}
        picks = [[place[id(values[f])] for f in features] for values in variants.values()]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(batch: pd.DataFrame) -> pd.Series:
            cells = batch.to_numpy(np.float64)
            stacked = np.concatenate([cells[:, pick] for pick in picks])
            found = np.asarray(predict(pd.DataFrame(stacked, columns=features)), dtype=np.float64)
            return pd.Series(list(found.reshape(len(picks), len(batch)).T))

        scores = score(F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(sent.values())]))
        df = df.withColumn("__batch_scores", scores)
        found = {name: F.get("__batch_scores", F.lit(i)) for i, name in enumerate(variants)}
        return df.withColumns(found).drop("__batch_scores")


class Trees:
    """A fitted forest or boosted ensemble as flat arrays of nodes, walked level by level for a whole batch.

    The nodes are those of the model's saved form. ``feature`` is -1 at a leaf; ``left`` and ``right`` are
    node numbers over all trees; a leaf's ``value`` already holds the tree's weight.
    """

    def __init__(self, roots, feature, threshold, left, right, value, depth: int, boosted: bool):
        self.roots, self.feature, self.threshold = roots, feature, threshold
        self.left, self.right, self.value = left, right, value
        self.depth, self.boosted = depth, boosted

    @classmethod
    def of(cls, model, path: str) -> Trees:
        """From a fitted random forest or gradient-boosted classifier, saved below ``path``."""
        model.write().overwrite().save(path)
        saved = SparkSession.active().read.parquet(f"{path}/data")
        # As many rows as the model has nodes.
        nodes = saved.select("treeID", "nodeData.*").toPandas().sort_values(["treeID", "id"])
        boosted = model.hasParam("stepSize")
        tree = nodes["treeID"].to_numpy(np.int64)
        first = np.searchsorted(tree, np.arange(tree.max() + 1))
        split = [s["featureIndex"] for s in nodes["split"]]
        if any(s["numCategories"] > 0 for s in nodes["split"]):
            raise ValueError("trees over categorical splits are not supported")
        threshold = [s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 else 0.0 for s in nodes["split"]]
        if boosted:
            value = nodes["prediction"].to_numpy(np.float64) * np.array(model.treeWeights)[tree]
        else:
            stats = np.stack(nodes["impurityStats"].to_numpy())
            value = stats[:, 1] / stats.sum(1) / len(first)
        base = first[tree]
        depth = max(t.depth for t in model.trees)
        return cls(
            first, np.array(split, np.int64), np.array(threshold, np.float64), nodes["leftChild"].to_numpy(np.int64) + base,
            nodes["rightChild"].to_numpy(np.int64) + base, value, depth, boosted,
        )

    def __call__(self, batch: pd.DataFrame) -> np.ndarray:
        x = batch.to_numpy(np.float64)
        row, total = np.arange(len(x)), np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[row, f] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-2 * total)) if self.boosted else total


class VoteScorer:
    """Soft vote: the mean probability of member scorers."""

    def __init__(self, members: Sequence[Scorer]):
        self.members = list(members)

    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        parts = {name: [] for name in variants}
        for i, member in enumerate(self.members):
            renamed = {f"__vote{i}_{name}": values for name, values in variants.items()}
            df = member.add_scores(df, renamed)
            for name in variants:
                parts[name].append(F.col(f"__vote{i}_{name}"))
        scratch = [f"__vote{i}_{n}" for i in range(len(self.members)) for n in variants]
        return df.withColumns({n: mean_of(cols) for n, cols in parts.items()}).drop(*scratch)


def score_rows(df: DataFrame, features: Sequence[str], scorers: dict[str, Scorer]) -> DataFrame:
    """Add ``prob_{model}`` for every model."""
    for model, scorer in scorers.items():
        df = scorer.add_scores(df, {f"prob_{model}": {f: F.col(f) for f in features}})
    return df


def score_long(
    df: DataFrame, features: Sequence[str], scorers: dict[str, Scorer], keep: Sequence[str]
) -> DataFrame:
    """One row per (row, model): ``keep`` columns, model, prob."""
    wide = score_rows(df, features, scorers)
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"prob_{m}").alias("prob")) for m in scorers]
    )
    return wide.select(*keep, F.explode_outer(pairs).alias("s")).select(*keep, "s.model", "s.prob")


def soft_vote(df: DataFrame, models: Sequence[str], name: str = "prob_ensemble") -> DataFrame:
    """Mean of the ``prob_{model}`` columns."""
    return df.withColumn(name, mean_of([F.col(f"prob_{m}") for m in models]))


def predict_class(prob: Column, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """1 above the threshold (or at it, when inclusive), else 0."""
    hit = prob >= threshold if inclusive else prob > threshold
    return F.when(hit, 1).otherwise(0)
