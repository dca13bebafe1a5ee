"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other, and each model sees, besides the words, the
probabilities of the categories before it. So that a later model learns from probabilities as good
as it will meet, it is trained with out-of-fold ones: each fold's come from a model that did not see
the fold.

Features are the presence of words and of word beginnings (4 and 6 bytes, which carry a stem through
its endings) that tell the labelled classes apart: for each category the ``FEATURES`` strongest by
chi-square among those in at least ``MIN_DOCS`` labelled documents. A feature enters a model with the
root of its chi-square, relative to the strongest one's, as its value: what chance alone may explain
must gain more to get a weight, but nothing is cut off, however few labels there are. The penalty is
that of a fixed prior (``PRIOR``), so it fades as labels grow in number. The models are fitted by Spark ML
on about ``SAMPLE`` labelled documents at most, chosen by a hash of their id; this bounds the fitting
at any size. Scoring reads every document once and moves no text.

A document is toxic if its toxic probability is at least ``THRESHOLD`` and above that of an empty text:
only what a document holds tells against it, never the share of toxic labels. Null or empty text has no
features and gets the intercepts' probabilities. A category without examples of both kinds, or without
any feature, has its share of ones as a constant probability, 0 without any labels; nothing is toxic then,
and a warning is logged. Rows of
``labels`` with a null id or a null label are not used; repeated ids of documents are all scored.
Empty documents give no rows. Further columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.llm.text import slices, word_features
from tiltframe.session import new_table_path

#: Categories in the order of the chain: name and the SQL over ``labels`` that gives 0 or 1.
CHAIN = (("poor", "1 - quality"), ("toxic", "toxic"))
SAMPLE = 20_000
FEATURES = 256
MIN_DOCS = 2
#: Penalty of the summed loss, on half the squares of the weights.
PRIOR = 0.02
FOLDS = 3
PREFIXES = (4, 6)
PARTS = 6
ITERATIONS = 30
THRESHOLD = 0.4

log = logging.getLogger(__name__)


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, feature) of a text column, in order."""
    words, first, heads = word_features(column, PREFIXES)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    owners, hashes = [owner], [words]
    for head in heads:
        owners.append(owner[head != 0])
        hashes.append(head[head != 0])
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    return owner[new], hashed[new]


def known_features(column: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, index in the sorted ``features``) of a text column."""
    words, first, heads = word_features(column, PREFIXES)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    pairs = []
    for hashed in (words, *heads):
        at = np.minimum(np.searchsorted(features, hashed), len(features) - 1)
        hit = np.flatnonzero(features[at] == hashed) if len(features) else np.zeros(0, np.int64)
        pairs.append(owner[hit] * len(features) + at[hit])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // max(1, len(features)), pairs % max(1, len(features))


@dataclass(frozen=True)
class Chain:
    """Fitted models: for each category the weights of the features, the weights of the categories
    before it, and the intercept."""

    names: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    links: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def probabilities(self, column: pa.Array) -> np.ndarray:
        owner, feature = known_features(column, self.features)
        out = np.zeros((len(column), len(self.names)))
        for k in range(len(self.names)):
            z = np.full(len(column), self.intercepts[k])
            if len(owner):
                z += np.bincount(owner, self.weights[k][feature], len(column))
            for j, link in enumerate(self.links[k]):
                z += link * out[:, j]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return out

    def judged(self, column: pa.Array, target: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities, and which texts are ``target``."""
        p, at = self.probabilities(column), self.names.index(target)
        least = self.probabilities(pa.array([""]))[0, at]
        return p, (p[:, at] >= threshold) & (p[:, at] > least)


def labelled(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, fold and the categories of about ``sample`` labelled documents at most."""
    rows = labels.select("doc_id", *(F.expr(sql).cast("double").alias(name) for name, sql in chain)).dropna()
    rows = rows.groupBy("doc_id").agg(*(F.max(name).alias(name) for name, _ in chain))
    every = max(1, -(-rows.count() // sample))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    # No more than about ``sample`` rows of a few numbers.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")


def strongest(rows: DataFrame, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the features that tell the categories apart, and for each category their
    values: the roots of their shares of the highest chi-square."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            owner, hashed = text_features(batch.column(0))
            unique, which = np.unique(hashed, return_inverse=True)
            columns = [pa.array(unique.view(np.int64)), pa.array(np.bincount(which, minlength=len(unique)))]
            for k in range(len(names)):
                labels = batch.column(1 + k).to_numpy()[owner]
                columns.append(pa.array(np.bincount(which, labels, len(unique)).astype(np.int64)))
            yield pa.record_batch(columns, ["feature", "docs", *names])

    kinds = "feature long, docs long, " + ", ".join(f"{n} long" for n in names)
    counts = rows.select("text", *names).mapInArrow(counted, kinds)
    counts = counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("docs", *names)))
    counts = counts.where(F.col("docs") >= MIN_DOCS)
    total = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in names)).first()
    with_ = F.col("docs").cast("double")
    strengths = []
    for name in names:
        n, ones = float(total.n), float(total[name] or 0)
        chi = F.lit(0.0)
        if 0 < ones < n:
            chi = n * (F.col(name) * n - with_ * ones) ** 2 / (with_ * (n + 1 - with_) * ones * (n - ones))
        strengths.append(chi.alias(f"chi_{name}"))
    counts = counts.select("feature", *strengths)
    chosen: dict[int, list[float]] = {}
    for name in names:
        best = counts.where(F.col(f"chi_{name}") > 0).orderBy(F.desc(f"chi_{name}"), "feature").limit(FEATURES)
        chosen |= {r[0]: list(r[1:]) for r in best.collect()}
    order = np.argsort(np.array(list(chosen), np.int64).view(np.uint64))
    features = np.array(list(chosen), np.int64).view(np.uint64)[order]
    chi = np.array(list(chosen.values()), float).reshape(len(chosen), len(names))[order].T
    return features, np.sqrt(chi / np.maximum(chi.max(1, initial=0, keepdims=True), 1e-300))


def fit(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> Chain:
    spark = docs.sparkSession
    names = tuple(name for name, _ in chain)
    path = new_table_path(spark, "labelled")
    labelled(docs, labels, chain, sample).write.parquet(path)
    rows = spark.read.parquet(path)
    features, values = strongest(rows, names)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            owner, feature = known_features(batch.column(0), features)
            x = np.zeros((batch.num_rows, len(features)), np.float64)
            x[owner, feature] = 1
            places = np.arange(0, x.size + 1, max(1, len(features)), dtype=np.int32)[: batch.num_rows + 1]
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(x.ravel()))
            yield pa.record_batch([lists, *(batch.column(i) for i in range(1, batch.num_columns))], ["x", "fold", *names])

    kinds = "x array<double>, fold int, " + ", ".join(f"{n} double" for n in names)
    weights, links, intercepts = np.zeros((len(names), len(features))), [], []
    if not len(features):
        log.warning("no labelled documents tell the categories apart: nothing is toxic")
        shares = rows.agg(*(F.avg(n).alias(n) for n in names)).first()
        intercepts = [float(np.log(max(s or 0, 1e-9) / max(1 - (s or 0), 1e-9))) for s in shares]
        return Chain(names, features, weights, tuple((0.0,) * k for k in range(len(names))), tuple(intercepts))
    dense_path = new_table_path(spark, "training-rows")
    rows.select("text", "fold", *names).mapInArrow(dense, kinds).write.parquet(dense_path)
    # About ``sample`` rows at most: a few partitions, as every step of the fitting reads them all.
    training = spark.read.parquet(dense_path).coalesce(PARTS).withColumn("before", F.array().cast("array<double>"))

    def inputs(part: DataFrame, k: int) -> DataFrame:
        """With features: the category's values of the features, and the categories before it."""
        part = part.withColumn("present", array_to_vector(F.concat("x", "before")))
        scaling = Vectors.dense(np.concatenate((values[k], np.ones(k))))
        return ElementwiseProduct(scalingVec=scaling, inputCol="present", outputCol="features").transform(part)

    def model(part: DataFrame, k: int):
        part = inputs(part, k).select("features", F.col(names[k]).alias("label"))
        both = part.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).first()
        if both.low == both.high:
            share = float(both.low or 0)
            log.warning("all labelled documents are alike in %s", names[k])
            return None, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        part = part.persist()
        fitted = LogisticRegression(maxIter=ITERATIONS, regParam=PRIOR / both.n, standardization=False).fit(part)
        part.unpersist()
        return fitted, float(fitted.intercept)

    def scored(part: DataFrame, k: int, fitted, intercept: float):
        if fitted is None:
            return part.withColumn("before", F.concat("before", F.array(F.lit(1 / (1 + np.exp(-intercept))))))
        out = fitted.transform(inputs(part, k))
        p = vector_to_array("probability")[1]
        return out.withColumn("before", F.concat("before", F.array(p))).select(*training.columns)

    for k in range(len(names)):
        fitted, intercept = model(training, k)
        coefficients = np.zeros(len(features) + k) if fitted is None else fitted.coefficients.toArray()
        weights[k] = coefficients[: len(features)] * values[k]
        links.append(tuple(map(float, coefficients[len(features) :])))
        intercepts.append(intercept)
        if k + 1 < len(names):
            parts = None
            for fold in range(FOLDS):
                held = training.where(F.col("fold") == fold)
                own = scored(held, k, *model(training.where(F.col("fold") != fold), k))
                parts = own if parts is None else parts.unionByName(own)
            next_path = new_table_path(spark, "out-of-fold")
            parts.write.parquet(next_path)
            training = spark.read.parquet(next_path).coalesce(PARTS)
    return Chain(names, features, weights, tuple(links), tuple(intercepts))


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, target: str = "toxic") -> DataFrame:
    """doc_id, p_<category> for every category, and whether the document is ``target``."""
    names = [f"p_{n}" for n in chain.names]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            p, hit = chain.judged(batch.column(1), target, threshold)
            columns = [batch.column(0), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(hit)]
            yield pa.record_batch(columns, ["doc_id", *names, target])

    kinds = "doc_id long, " + ", ".join(f"{n} double" for n in names) + f", {target} boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judged, kinds)


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    text_at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            _, toxic = chain.judged(batch.column(text_at).cast(pa.string()), "toxic", threshold)
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(kept, docs.schema)
