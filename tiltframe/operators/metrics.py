"""Classification metrics and curves as aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltframe.functions.chunked import global_positions, with_carry
from tiltframe.functions.scalar import mean_of
from tiltframe.operators.scorers import predict_class

# Scores are cut into intervals of this share of a unit of their log-odds when they have to be
# ordered, so that the scores of a rare event are spread as well as those around one half.
CHUNKS_PER_LOGIT = 4096


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(df: DataFrame, by: Sequence[str] = (), predicted: str = "predicted") -> DataFrame:
    """tp, fp, tn, fn of 0/1 columns ``label`` and ``predicted``."""
    y, c = F.col("label") == 1, F.col(predicted) == 1
    count = lambda hit: F.sum(F.when(hit, 1).otherwise(0)).cast("bigint")
    return df.groupBy(*by).agg(
        count(y & c).alias("tp"),
        count(~y & c).alias("fp"),
        count(~y & ~c).alias("tn"),
        count(y & ~c).alias("fn"),
    )


def binary_metrics(df: DataFrame, by: Sequence[str] = (), predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined) and the confusion counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return confusion_counts(df, by, predicted).select(
        *by,
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "tp",
        "fp",
        "tn",
        "fn",
    )


def sensitivity_specificity(
    df: DataFrame, by: Sequence[str] = (), predicted: str = "predicted"
) -> DataFrame:
    return confusion_counts(df, by, predicted).select(
        *by,
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
        _ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        "tp",
        "fp",
        "tn",
        "fn",
    )


def _cumulative(df: DataFrame, by: Sequence[str], prob: str) -> DataFrame:
    """Per distinct score, from the highest down: its own and the running label counts.

    Rows collapse to one per score before anything is ordered, and the order is taken inside
    score intervals, so neither a popular score nor a large table lands in one task. A null score
    fails the query: it has no place in the order.
    """
    no_score = F.raise_error(F.lit(f"{prob} is null"))
    df = df.withColumn(prob, F.when(F.col(prob).isNull(), no_score).otherwise(F.col(prob)))
    y = F.col("label") == 1
    scores = df.groupBy(*by, F.col(prob).alias("score")).agg(
        F.sum(F.when(y, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(y, 0).otherwise(1)).cast("bigint").alias("neg"),
    )
    score = F.col("score")
    odds = F.greatest(score, F.lit(1e-300)) / F.greatest(1 - score, F.lit(1e-17))
    chunk = -F.floor(F.log(odds) * CHUNKS_PER_LOGIT).cast("bigint")
    carried = with_carry(
        scores.withColumn("__chunk", chunk),
        by,
        "__chunk",
        {"__pos": (F.sum("pos"), F.sum), "__neg": (F.sum("neg"), F.sum)},
    )
    inside = (
        Window.partitionBy(*by, "__chunk")
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return carried.select(
        *by,
        "score",
        "pos",
        "neg",
        (F.sum("pos").over(inside) + F.coalesce("__pos", F.lit(0))).alias("tp"),
        (F.sum("neg").over(inside) + F.coalesce("__neg", F.lit(0))).alias("fp"),
    )


def roc_auc(df: DataFrame, by: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    """Area under the ROC curve; tied scores count one half. Null without both classes."""
    wins = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return (
        _cumulative(df, by, prob)
        .groupBy(*by)
        .agg(
            F.try_divide(
                F.sum(wins), F.sum("pos").cast("double") * F.sum("neg").cast("double")
            ).alias("roc_auc")
        )
    )


def evaluate_models(
    df: DataFrame, by: Sequence[str] = ("model",), prob: str = "prob", threshold: float = 0.5
) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of every model from long scores
    (label, model, prob)."""
    keys = list(by) or ["__all"]
    classed = df.withColumn("predicted", predict_class(F.col(prob), threshold))
    if not by:
        classed = classed.withColumn("__all", F.lit(1))
    joined = binary_metrics(classed, keys).join(roc_auc(classed, keys, prob), keys)
    return joined.select(*by, "accuracy", "precision", "recall", "f1", "roc_auc")


def joined_votes(scores: dict[str, DataFrame], labels: DataFrame, case: str = "case") -> DataFrame:
    """Per-model probabilities joined by case with their mean; a case that one side lacks fails
    the query. Inputs: model -> (case, prob); labels (case, label)."""
    frames = [df.select(case, F.col("prob").alias(f"prob_{m}")) for m, df in scores.items()]
    frames.append(labels.select(case, "label"))
    joined = reduce(lambda a, b: a.join(b, case, "full_outer"), frames)
    columns = [f"prob_{m}" for m in scores]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*columns, "label"]])
    vote = F.when(missing, F.raise_error(F.lit("models cover different cases"))).otherwise(
        mean_of([F.col(c) for c in columns])
    )
    return joined.withColumn("prob", vote)


def ensemble_metrics(
    scores: dict[str, DataFrame],
    labels: DataFrame,
    case: str = "case",
    threshold: float = 0.5,
    inclusive: bool = False,
) -> DataFrame:
    """Metrics of the mean of per-model probabilities joined by case."""
    votes = joined_votes(scores, labels, case).withColumn(
        "predicted", predict_class(F.col("prob"), threshold, inclusive)
    )
    votes = votes.withColumn("__all", F.lit(1))
    return (
        binary_metrics(votes, ["__all"])
        .join(roc_auc(votes, ["__all"]), "__all")
        .select("accuracy", "precision", "recall", "f1", "roc_auc", "tp", "fp", "tn", "fn")
    )


def contiguous_folds(
    df: DataFrame, key: str, folds: int = 5, stratify: str | None = None
) -> DataFrame:
    """Add ``fold``: consecutive blocks in key order (within each class when stratified); the
    first n % folds blocks have one row more."""
    keys = [stratify] if stratify else []
    df = global_positions(df, key, "__pos", keys)
    if stratify:
        sizes = df.groupBy(stratify).agg(F.count("*").alias("__n"))
        df = df.join(sizes, stratify)
    else:
        df = df.withColumn("__n", F.lit(df.count()))
    small, extra = F.expr(f"__n div {folds}"), F.col("__n") % folds
    long_part = extra * (small + 1)
    fold = F.when(
        F.col("__pos") < long_part, F.floor(F.col("__pos") / F.greatest(small + 1, F.lit(1)))
    ).otherwise(extra + F.floor((F.col("__pos") - long_part) / F.greatest(small, F.lit(1))))
    return df.withColumn("fold", fold.cast("int")).drop("__pos", "__n")


def curve_points(df: DataFrame, by: Sequence[str], prob: str = "prob") -> DataFrame:
    """ROC and precision-recall points at every distinct score."""
    points = _cumulative(df, by, prob)
    totals = points.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tp, fp = F.col("tp"), F.col("fp")
    return points.join(totals, list(by)).select(
        *by,
        "score",
        "pos",
        "neg",
        _ratio(fp, F.col("n")).alias("fpr"),
        _ratio(tp, F.col("p")).alias("tpr"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, F.col("p")).alias("recall"),
        tp.alias("tp"),
        fp.alias("fp"),
        "p",
        "n",
    )


def mean_roc(points: DataFrame, fold: str = "fold", by: Sequence[str] = (), grid: int = 100) -> DataFrame:
    """Mean true-positive rate over folds on an even grid of false-positive rates.

    A score with negatives spans the stretch (fp - neg, fp] of the curve and yields just the grid
    points on it: no join between grid and curve. At a vertical rise the upper end counts, so
    the value at a point also looks at the highest rate reached there.
    """
    last = grid - 1
    low, high = F.col("fp") - F.col("neg"), F.col("fp")
    # Grid points g with low <= g * n / last < high; the last one closes the curve.
    first_g = F.ceil(low * last / F.col("n")).cast("int")
    stop_g = (F.ceil(high * last / F.col("n")) - 1).cast("int")
    on_segment = points.where("neg > 0 and n > 0").where(first_g <= stop_g)
    below = F.col("tp") - F.col("pos")
    rows = on_segment.select(
        *by,
        fold,
        F.explode(F.sequence(first_g, stop_g)).alias("g"),
        *[c.alias(n) for n, c in (("a", low), ("b", below), ("pos", F.col("pos")))],
        "neg",
        "p",
        "n",
    )
    along = (F.col("g") * F.col("n") / F.lit(float(last)) - F.col("a")) / F.col("neg")
    inner = rows.select(
        *by, fold, "g", _ratio(F.col("b") + F.col("pos") * along, F.col("p")).alias("tpr")
    )
    end = points.select(*by, fold).distinct().select(
        *by, fold, F.lit(last).alias("g"), F.lit(1.0).alias("tpr")
    )
    return (
        inner.unionByName(end)
        .groupBy(*by, (F.col("g") / F.lit(float(last))).alias("fpr"))
        .agg(F.avg("tpr").alias("mean_tpr"))
    )


def out_of_fold_confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of out-of-fold class predictions (label, prob)."""
    return confusion_counts(df.withColumn("predicted", predict_class(F.col("prob"))), by)
