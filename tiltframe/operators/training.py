"""Model training on Spark ML: distributed fits, sigmoid calibration, cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltframe.operators import forests, networks
from tiltframe.operators.folded import CalibratedMargins, LinearLogistic, fit_folds, fit_sigmoids, folded_scores
from tiltframe.operators.metrics import contiguous_folds, evaluate_models
from tiltframe.operators.scaling import class_weights
from tiltframe.operators.scorers import BatchScorer, BinnedScorer, MLScorer, Scorer, Variants, bin_number
from tiltframe.operators.split import case_hash
from tiltframe.session import drop_table, new_table_path

VECTOR, LABEL, WEIGHT = "__vector", "label", "__weight"
#: Bins that a tree tells apart in a feature, as Spark's trees do by default.
BINS = 32
#: From so many rows on, boosted trees learn from counted cells of bins.
CELLS_FROM = 1_000_000
#: From so many rows on, the forests of all folds are grown together.
TOGETHER_FROM = 1_000_000
#: From so many rows on, networks learn from stored blocks of rows.
BLOCKS_FROM = 1_000_000


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    vector = array_to_vector(F.array(*[F.col(f).cast("double") for f in features]))
    return df.withColumn(VECTOR, vector).withColumn(LABEL, F.col(LABEL).cast("double"))


def train_logistic(
    df: DataFrame, features: Sequence[str], c: float = 1.0, balanced: bool = False
) -> LinearLogistic:
    """L2 logistic regression at the least summed loss plus half the squared weights over C."""
    rows = df.withColumn("__fold", F.lit(0))
    return LinearLogistic(fit_folds(rows, features, "__fold", 0, c, balanced)[-1], features)


class SigmoidCalibrated:
    """Mean over members of sigmoid(a * raw + b), the raw score being one number per row."""

    def __init__(self, members: Sequence[tuple[Scorer, float, float]]):
        self.members = list(members)

    def add_scores(self, df: DataFrame, variants: Variants) -> DataFrame:
        parts: dict[str, list[Column]] = {name: [] for name in variants}
        scratch = []
        for i, (member, a, b) in enumerate(self.members):
            renamed = {f"__cal{i}_{name}": values for name, values in variants.items()}
            df = member.add_scores(df, renamed)
            scratch += list(renamed)
            for name in variants:
                raw = F.col(f"__cal{i}_{name}")
                parts[name].append(1.0 / (1.0 + F.exp(-(F.lit(a) * raw + F.lit(b)))))
        averaged = {n: sum(c[1:], c[0]) / F.lit(float(len(c))) for n, c in parts.items()}
        return df.withColumns(averaged).drop(*scratch)


def _sigmoid_fit(scored: DataFrame, raw: str) -> tuple[float, float]:
    data = scored.select(
        array_to_vector(F.array(F.col(raw))).alias(VECTOR), F.col(LABEL).cast("double").alias(LABEL)
    )
    # The fit reads its rows twice, and each row is scored by a whole forest.
    data = data.persist()
    fit = LogisticRegression(featuresCol=VECTOR, labelCol=LABEL, maxIter=200, tol=1e-8).fit(data)
    data.unpersist()
    return float(fit.coefficients[0]), float(fit.intercept)


def _with_folds(df: DataFrame, case: str, folds: int, seed: int) -> DataFrame:
    return df.withColumn("__fold", (case_hash(case, seed) % folds).cast("int"))


def _calibrate(
    df: DataFrame,
    features: Sequence[str],
    fit: Callable[[DataFrame], Scorer],
    case: str,
    folds: int,
    seed: int,
) -> SigmoidCalibrated:
    """One member per fold: fitted on the other folds, its sigmoid fitted on this fold."""
    data = _with_folds(df, case, folds, seed)
    return _calibrated(data, features, (fit(data.where(F.col("__fold") != i)) for i in range(folds)))


def _calibrated(data: DataFrame, features: Sequence[str], scorers: Iterable[Scorer]) -> SigmoidCalibrated:
    """The scorer of each ``__fold`` with its sigmoid, fitted on this fold."""
    members = []
    for i, scorer in enumerate(scorers):
        held = scorer.add_scores(
            data.where(F.col("__fold") == i), {"__raw": {f: F.col(f) for f in features}}
        )
        members.append((scorer, *_sigmoid_fit(held, "__raw")))
    return SigmoidCalibrated(members)


def train_forest_calibrated(
    df: DataFrame,
    features: Sequence[str],
    trees: int = 1000,
    depth: int = 10,
    case: str = "case",
    folds: int = 5,
    seed: int = 7,
    together_from: int = TOGETHER_FROM,
) -> SigmoidCalibrated:
    """Random forest with sigmoid calibration over out-of-fold scores.

    Spark grows the forests one after the other. From ``together_from`` rows on, those of all folds are grown
    together by the same rules (``forests``), with bins cut at quantiles of all rows.
    """
    if depth <= forests.DEEPEST and _plain_rows(df, features) >= together_from:
        return _calibrated_together(df, features, trees, depth, case, folds, seed)

    def fit(part: DataFrame) -> Scorer:
        # A row's node in every tree is kept between levels: without it each level walks all trees from
        # their roots. The lineage is as long as the trees are deep, so it needs no checkpoints.
        forest = RandomForestClassifier(
            featuresCol=VECTOR,
            labelCol=LABEL,
            numTrees=trees,
            maxDepth=depth,
            seed=seed,
            cacheNodeIds=True,
            checkpointInterval=-1,
        )
        return MLScorer(forest.fit(_assembled(part, features)), features)

    return _calibrate(df, features, fit, case, folds, seed)


def _plain_rows(df: DataFrame, features: Sequence[str]) -> int:
    """The rows, or 0 if a label is not 0 or 1 or a feature is null in some row."""
    odd = ~F.coalesce(F.col(LABEL).isin(0, 1), F.lit(False))
    for f in features:
        odd |= F.col(f).cast("double").isNull()
    found = df.agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).first()
    return 0 if found["odd"] else found["n"]


def _calibrated_together(
    df: DataFrame, features: Sequence[str], trees: int, depth: int, case: str, folds: int, seed: int
) -> SigmoidCalibrated:
    spark = df.sparkSession
    path = new_table_path(spark, "fold-rows")
    # The rows are read for the bins, for the blocks and once per fold.
    values = [F.col(f).cast("double").alias(f) for f in features]
    key = F.xxhash64(case, *features, LABEL).alias("__key")
    data = _with_folds(df, case, folds, seed).where(F.col("__fold").isNotNull())
    data.select(*values, F.col(LABEL).cast("int").alias(LABEL), "__fold", key).write.parquet(path)
    data = spark.read.parquet(path)
    edges = _bin_edges(data, features)
    grown = forests.fit_forests(data, features, LABEL, "__fold", "__key", edges, folds, trees, depth, seed)
    calibrated = _calibrated(data, features, (BatchScorer(forest, features) for forest in grown))
    drop_table(spark, path)
    return calibrated


def train_svm_calibrated(
    df: DataFrame,
    features: Sequence[str],
    case: str = "case",
    folds: int = 5,
    seed: int = 7,
    c: float = 1.0,
) -> CalibratedMargins:
    """Balanced linear SVM (squared hinge) with sigmoid probabilities: the margins of all folds are
    fitted together, then the sigmoids of all folds."""
    data = _with_folds(df, case, folds, seed)
    weights = fit_folds(data, features, "__fold", folds, c, True, "squared_hinge")[:folds]
    held = data.withColumn("__raw", LinearLogistic(weights, features, "__fold").margin({f: F.col(f) for f in features}))
    return CalibratedMargins(weights, fit_sigmoids(held, "__raw", "__fold", folds), features)


def _copies(df: DataFrame, case: str, seed: int) -> Column:
    """How often each row is repeated for its balanced weight (relative to the smallest); the fractional
    part is settled by a hash of the case, so the result is the same in every run."""
    rows = {r[LABEL]: r["weight"] for r in class_weights(df, LABEL).collect()}
    least = min(rows.values())
    weight = F.lit(1.0)
    for value, w in rows.items():
        weight = F.when(F.col(LABEL) == value, F.lit(w / least)).otherwise(weight)
    share = case_hash(case, seed) / F.lit(float(2**32))
    return (F.floor(weight) + F.when(share < weight - F.floor(weight), 1).otherwise(0)).cast("int")


def oversample(df: DataFrame, case: str = "case", seed: int = 7) -> DataFrame:
    """Repeat rows by their balanced weight."""
    copies = _copies(df, case, seed)
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy")


def train_mlp(
    df: DataFrame,
    features: Sequence[str],
    seed: int = 123,
    hidden: Sequence[int] = (60, 30),
    balanced: bool = False,
    case: str = "case",
    iterations: int = 100,
    blocks_from: int = BLOCKS_FROM,
) -> MLScorer:
    """Dense network with two hidden layers; class weights by repeating rows.

    From ``blocks_from`` rows on, L-BFGS goes over stored blocks of rows (``networks``), in which a repeated
    row is one that counts several times. It starts from the weights that Spark's perceptron draws for
    ``seed`` and ends as one.
    """
    layers = [len(features), *hidden, 2]
    network = MultilayerPerceptronClassifier(
        featuresCol=VECTOR, labelCol=LABEL, layers=layers, seed=seed, maxIter=iterations
    )
    if _plain_rows(df, features) < blocks_from:
        data = oversample(df, case, seed) if balanced else df
        return MLScorer(network.fit(_assembled(data, features)), features)
    spark = df.sparkSession
    often = _copies(df, case, seed) if balanced else F.lit(1)
    path = new_table_path(spark, "network-blocks")
    # Every step reads all blocks: alike pieces keep all cores busy to its end.
    values = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate((*map(F.col, features), F.col(LABEL), often))])
    pieces = values.repartition(spark.sparkContext.defaultParallelism)
    pieces.mapInArrow(networks.packed, "rows binary").write.parquet(path)
    no_rows = spark.createDataFrame([(Vectors.dense([0.0] * len(features)), float(y)) for y in (0, 1)], [VECTOR, LABEL])
    none = network.copy({network.maxIter: 0})
    start = none.fit(no_rows).weights.toArray()
    weights = networks.fit_network(spark.read.parquet(path), layers, start, iterations)
    drop_table(spark, path)
    return MLScorer(none.copy({none.initialWeights: Vectors.dense(weights)}).fit(no_rows), features)


def _bin_edges(df: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Lower ends of the bins of each feature but the first one: its values if there are no more than
    ``BINS``, else its quantiles."""
    values = [F.col(f).cast("double") for f in features]
    about = df.agg(*[F.approx_count_distinct(v).alias(f) for f, v in zip(features, values, strict=True)]).first()
    few = [f for f in features if about[f] <= 2 * BINS]
    many = [f for f in features if f not in few]
    edges = {}
    if few:
        found = df.agg(*[F.collect_set(F.col(f).cast("double")).alias(f) for f in few]).first()
        edges = {f: sorted(found[f])[1:] for f in few if len(found[f]) <= BINS}
        many += [f for f in few if f not in edges]
    if many:
        shares = [i / BINS for i in range(1, BINS)]
        cuts = df.select(*[F.col(f).cast("double").alias(f) for f in many]).approxQuantile(many, shares, 0.001)
        edges |= {f: sorted(set(found)) for f, found in zip(many, cuts, strict=True)}
    return {f: edges[f] for f in features}


def _cells(df: DataFrame, features: Sequence[str], edges: dict[str, list[float]]) -> DataFrame:
    """The bin numbers of the rows with their label, each combination once, and its ``__rows``. The layout
    depends on the cells alone."""
    binned = df.select(*[bin_number(F.col(f).cast("double"), edges[f]).alias(f) for f in features], LABEL)
    keys = [*features, LABEL]
    counted = binned.groupBy(*keys).agg(F.count("*").alias("__rows"))
    pieces = df.sparkSession.sparkContext.defaultParallelism
    return counted.repartition(pieces, *keys).sortWithinPartitions(*keys)


def train_boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    positive_weight: float = 4.0,
    rounds: int = 100,
    depth: int = 5,
    seed: int = 7,
    cells_from: int = CELLS_FROM,
) -> Scorer:
    """Gradient-boosted trees with a weight on the positive class.

    Each round passes over the rows once per level. Trees see no more of a row than its bins and its
    label, so from ``cells_from`` rows on equal ones are counted first and learned from once, with their
    number as weight: what is passed over is bounded by the combinations of bins, not by the rows. The
    bins are cut at quantiles of all rows then, where Spark cuts them at those of some 10,000.
    """
    edges = _bin_edges(df, features) if df.count() >= cells_from else None
    data = df if edges is None else _cells(df, features, edges)
    weight = F.when(F.col(LABEL) == 1, positive_weight).otherwise(1.0)
    if edges is not None:
        weight = weight * F.col("__rows")
    data = _assembled(data, features).withColumn(WEIGHT, weight)
    gbt = GBTClassifier(
        featuresCol=VECTOR,
        labelCol=LABEL,
        weightCol=WEIGHT,
        maxIter=rounds,
        maxDepth=depth,
        maxBins=BINS,
        stepSize=0.3,
        seed=seed,
    )
    if edges is None:
        return MLScorer(gbt.fit(data), features)
    data = data.persist()
    model = gbt.fit(data)
    data.unpersist()
    return BinnedScorer(MLScorer(model, features), edges)


def out_of_fold_scores(
    df: DataFrame,
    features: Sequence[str],
    fit: Callable[[DataFrame], Scorer],
    key: str,
    folds: int = 5,
    stratify: str | None = LABEL,
) -> DataFrame:
    """(key, label, fold, prob): every row scored by the model that did not see its fold."""
    data = contiguous_folds(df.select(key, *features, LABEL), key, folds, stratify)
    out = None
    for i in range(folds):
        scorer = fit(data.where(F.col("fold") != i))
        held = scorer.add_scores(
            data.where(F.col("fold") == i), {"prob": {f: F.col(f) for f in features}}
        ).select(key, F.col(LABEL).cast("int").alias(LABEL), "fold", "prob")
        out = held if out is None else out.unionByName(held)
    return out


def logistic_out_of_fold(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    folds: int = 5,
    stratify: str | None = LABEL,
    c: float = 1.0,
    balanced: bool = False,
) -> DataFrame:
    """``out_of_fold_scores`` of logistic regression, with the models of all folds fitted together."""
    data = contiguous_folds(df.select(key, *features, LABEL), key, folds, stratify)
    scored = folded_scores(data, features, "fold", folds, c, balanced)
    return scored.select(key, F.col(LABEL).cast("int").alias(LABEL), "fold", "prob")


def cv_scores(scores: DataFrame) -> DataFrame:
    """Metrics per fold with their mean and sample deviation over the folds."""
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    per_fold = evaluate_models(scores, by=["fold"])
    rows = per_fold.select(F.col("fold").cast("string").alias("fold"), *names)
    summary = per_fold.agg(
        F.array(
            F.struct(F.lit("mean").alias("fold"), *[F.avg(c).alias(c) for c in names]),
            F.struct(F.lit("std").alias("fold"), *[F.stddev_samp(c).alias(c) for c in names]),
        ).alias("s")
    ).select(F.inline_outer("s"))
    return rows.unionByName(summary)
