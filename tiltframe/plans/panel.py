"""Effects, ranks, overlap and vote of a model panel, one pass over the feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tiltframe.operators import consensus, effects, ranking
from tiltframe.operators.scorers import Scorer
from tiltframe.schemas import KEYS


def panel_frame(
    df: DataFrame,
    plan: Sequence[effects.Perturbation],
    scorers: dict[str, Scorer],
    rank: int | None = None,
    p: float = 0.9,
    weights: dict[str, float | None] | None = None,
    policy: str = "sum",
    baselines: Sequence[float | None] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Normalized panel with ranks, pairwise overlaps and consensus, all inside the row."""
    features = [step.feature for step in plan]
    depth = rank or len(features)
    rows = effects.static_effects(df, plan, scorers, baselines, carry=carry)
    rows = ranking.rank_effects(effects.normalize_effects(rows), depth)
    rows = ranking.with_rbos(rows, list(scorers), depth, p)
    return consensus.with_consensus(rows, features, weights, policy)


def panel_report(
    df: DataFrame,
    plan: Sequence[effects.Perturbation],
    scorers: dict[str, Scorer],
    label: str = "label",
    **kw,
) -> DataFrame:
    """One row per case: vote, mean overlap, ensemble risk, best and most abnormal feature."""
    features = [step.feature for step in plan]
    carry = [*features, label]
    rows = panel_frame(df, plan, scorers, carry=carry, **kw)
    rows = rows.withColumns(
        {
            "rbo": ranking.mean_rbo(),
            "orig_prob_ensemble": consensus.ensemble_risk(),
            "most_abnormal": consensus.most_abnormal(features),
        }
    )
    rows = consensus.best_feature(rows, features)
    return consensus.consensus_rows(rows).drop(*features)


def weights_from_metrics(metrics: DataFrame, name: str) -> dict[str, float]:
    """Model weights for the vote from an evaluation table: one number per model."""
    return {row["model"]: row[name] for row in metrics.select("model", name).collect()}
