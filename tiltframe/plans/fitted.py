"""From a feature table to the consensus of models fitted on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.operators import consensus, effects, metrics
from tiltframe.operators.scaling import Scaler
from tiltframe.operators.scorers import Scorer, score_long
from tiltframe.operators.split import split_by_case
from tiltframe.plans.panel import panel_frame, weights_from_metrics
from tiltframe.session import new_table_path
from tiltframe.sources.tables import replace_table


def fitted_panel(
    rows: DataFrame,
    features: Sequence[str],
    numeric: Sequence[str],
    fits: dict[str, Callable[[DataFrame], Scorer]],
    metric: str | None = "roc_auc",
    label: str = "label",
    **kw,
) -> DataFrame:
    """One row per validation case: the models' vote on it, weighted by how well each model does.

    The cases are split; ``numeric`` columns are standardized by the training cases, whose models then
    score the validation cases and every perturbed copy of them. ``metric`` (a column of
    ``evaluate_models`` over the validation cases) weighs the votes; None weighs all alike.
    """
    spark = rows.sparkSession
    train, valid = split_by_case(rows)
    scaler = Scaler.fit(train, numeric)
    # Fits read the training rows many times.
    train = replace_table(scaler.transform(train), new_table_path(spark, "training-rows"))
    valid = replace_table(scaler.transform(valid), new_table_path(spark, "validation-rows"))
    fitted = {name: fit(train) for name, fit in fits.items()}
    weights = None
    if metric:
        scores = score_long(valid, features, fitted, [label])
        weights = weights_from_metrics(metrics.evaluate_models(scores.withColumn("label", F.col(label))), metric)
    plan = effects.perturbation_plan(train, features)
    return consensus.consensus_rows(panel_frame(valid, plan, fitted, weights=weights, carry=[label], **kw))
