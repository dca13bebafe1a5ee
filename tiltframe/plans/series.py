"""The series side of a train/validation split, and the sweep that begins at the study table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.operators import effects, scaling, split, values
from tiltframe.operators.scorers import Scorer
from tiltframe.session import new_table_path
from tiltframe.sources.tables import replace_table


def series_sides(
    df: DataFrame,
    features: Sequence[str],
    outcome: str,
    forced_valid: DataFrame | None = None,
    length: int | None = None,
) -> DataFrame:
    """One row per case: is_valid, label, and a padded sequence per feature, earliest step first.

    The cases are split as those of the static rows are, so both forms of a model are validated on the
    same cases. Missing values become the side's own means; both sides are standardized by the training
    side; a side's sequences are as long as it has distinct timepoints, or ``length``.
    """
    marked = split.with_split(df.select("case", "timepoint", *features, outcome), forced_valid=forced_valid)
    marked = replace_table(marked, new_table_path(df.sparkSession, "series-split"))
    sides = [scaling.impute(marked.where(F.col("is_valid") == side), features) for side in (0, 1)]
    scaler = scaling.Scaler.fit(sides[0], features)
    out = None
    for side, rows in enumerate(sides):
        padded = values.sequence_pad(scaler.transform(rows), features, length, label=outcome)
        padded = padded.select("case", F.lit(side).alias("is_valid"), "label", *features)
        out = padded if out is None else out.unionByName(padded)
    return out


def study_sweep(
    study: DataFrame,
    features: Sequence[str],
    scorers: dict[str, Scorer],
    baselines: Sequence[float | None] = (None, 0.5, 0.7, 0.9),
    outcome: str = "ventilated",
    case: str = "icustay_id",
) -> DataFrame:
    """Normalized effects of every model and size on the stays of a study table, long form: the last
    known value of each feature, imputed by its mean and standardized, then perturbed."""
    rows = values.last_value_features(study, features, outcome, case).withColumnRenamed(case, "case")
    # Two passes over the stays follow, for the means and for the spread.
    rows = replace_table(rows, new_table_path(study.sparkSession, "study-rows"))
    scaler = scaling.Scaler.fit(scaling.impute(rows, features), features)
    # A missing value becomes the mean, which is exactly 0 in these units.
    rows = scaler.transform(rows).fillna(0.0, subset=list(features)).withColumn("timepoint", F.lit(0))
    plan = [effects.Perturbation(f) for f in features]
    return effects.perturbation_sweep(rows, plan, scorers, baselines)
