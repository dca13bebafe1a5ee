"""Weighted votes over ranked features and single-row summaries of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltframe.functions.scalar import add_all, literal_array
from tiltframe.schemas import NOT_FOUND

_CANDIDATE = "struct<score:double,order:int,feature:string>"


def _weight(model: Column, weights: dict[str, float | None] | None) -> Column:
    chosen = F.lit(1.0)
    for name, weight in (weights or {}).items():
        if weight is not None:
            chosen = F.when(model == name, F.lit(float(weight))).otherwise(chosen)
    return chosen


def with_consensus(
    df: DataFrame,
    features: Sequence[str],
    weights: dict[str, float | None] | None = None,
    policy: str = "sum",
) -> DataFrame:
    """Add ``vote`` STRUCT<winner, score, consensus, models, avg_percent_consensus,
    avg_percent_all> from ``ranks`` and ``panel``.

    A feature scores the sum of |coefficient| x model weight over the models that rank it
    ('mean' divides by their number). Highest score wins, then the smaller feature name.
    The two averages are the mean percent drop of predicted risk when the winner is changed,
    over its voters and over all ranked models.
    """
    if policy not in ("sum", "mean"):
        raise ValueError("policy must be 'sum' or 'mean'")
    votes = F.flatten(
        F.transform(
            "ranks",
            lambda m: F.transform(
                F.filter(m["ranked"], lambda r: r["feature"] != NOT_FOUND),
                lambda r: F.struct(
                    m["model"].alias("model"),
                    r["feature"].alias("feature"),
                    (F.abs(r["effect"]) * _weight(m["model"], weights)).alias("score"),
                ),
            ),
        )
    )
    # Candidates in descending name order, so that of equal scores the smaller name is greatest.
    names = sorted(features, reverse=True)

    def candidate(name: Column, order: Column) -> Column:
        def scored(mine: Column) -> Column:
            total = add_all(mine, lambda v: v["score"])
            if policy == "mean":
                total = total / F.greatest(F.size(mine), F.lit(1))
            found = F.struct(total.alias("score"), order.alias("order"), name.alias("feature"))
            return F.when(F.size(mine) > 0, found).cast(_CANDIDATE)

        # An array of one binds the filtered votes, so that they are found only once.
        return F.get(F.transform(F.array(F.filter("__votes", lambda v: v["feature"] == name)), scored), 0)

    df = df.withColumn("__votes", votes)
    df = df.withColumn("__top", F.array_max(F.transform(literal_array(names), candidate)))
    top = F.col("__top")
    mine = F.filter("__votes", lambda v: v["feature"] == top["feature"])
    best = F.when(
        top.isNotNull(),
        F.struct(top["score"].alias("score"), top["feature"].alias("feature"), F.sort_array(mine["model"]).alias("models")),
    )
    df = df.withColumn("__best", best)
    winner = F.col("__best")

    # Per ranked model: percent risk drop of the winning feature.
    drops = F.transform(
        F.filter("panel", lambda m: F.array_contains(F.col("ranks.model"), m["model"])),
        lambda m: F.struct(
            m["model"].alias("model"),
            (
                100.0
                * (
                    m["orig_prob"]
                    - F.get(
                        F.filter(m["effects"], lambda e: e["feature"] == winner["feature"]), 0
                    )["perturb_prob"]
                    + 1e-6
                )
                / (m["orig_prob"] + 1e-6)
            ).alias("drop"),
        ),
    )
    df = df.withColumn("__drops", F.when(winner.isNotNull(), drops))
    voters = F.filter("__drops", lambda d: F.array_contains(winner["models"], d["model"]))
    mean_drop = lambda items: add_all(items, lambda d: d["drop"]) / F.size(items)
    vote = F.struct(
        winner["feature"].alias("winner"),
        winner["score"].alias("score"),
        F.when(winner.isNotNull(), F.size(winner["models"])).alias("consensus"),
        winner["models"].alias("models"),
        F.when(winner.isNotNull(), mean_drop(voters)).alias("avg_percent_consensus"),
        F.when(winner.isNotNull(), mean_drop(F.col("__drops"))).alias("avg_percent_all"),
    )
    return df.withColumn("vote", vote).drop("__votes", "__top", "__best", "__drops")


def consensus_rows(df: DataFrame) -> DataFrame:
    """The vote as flat columns."""
    rest = [c for c in df.columns if c not in ("panel", "ranks", "rbos", "vote")]
    return df.select(*rest, unpacked(F.col("vote")))


def unpacked(struct: Column) -> Column:
    """Fields of a computed struct as columns. Going through a generator keeps later filters on
    the fields above this point; through a plain projection the optimizer would copy the whole
    vote into the filter and compute it twice."""
    return F.inline_outer(F.array(struct))


def overlap_of_voters() -> tuple[Column, Column]:
    """Least and greatest overlap among the model pairs that both voted for the winner."""
    both = lambda r: F.array_contains("vote.models", r["model_a"]) & F.array_contains(
        "vote.models", r["model_b"]
    )
    among = F.transform(F.filter("rbos", both), lambda r: r["rbo"])
    return F.array_min(among).alias("rbo_min"), F.array_max(among).alias("rbo_max")


def consensus_with_overlap(df: DataFrame) -> DataFrame:
    """The vote with rbo_min and rbo_max; null for a single voter."""
    rest = [c for c in df.columns if c not in ("panel", "ranks", "rbos", "vote")]
    return df.select(
        *rest,
        "vote.winner",
        "vote.score",
        "vote.consensus",
        "vote.avg_percent_consensus",
        "vote.avg_percent_all",
        *overlap_of_voters(),
    )


def ensemble_risk(models: Sequence[str] | None = None) -> Column:
    """Mean original probability of the panel's models."""
    entries = F.col("panel")
    if models is not None:
        entries = F.filter(entries, lambda m: m["model"].isin(list(models)))
    return add_all(entries, lambda m: m["orig_prob"]) / F.size(entries)


def _per_feature(features: Sequence[str], value) -> Column:
    """STRUCT<feature, order, a, b> per feature, with values over the panel's models."""

    def one(name: Column, order: Column) -> Column:
        mine = F.transform(
            "panel", lambda m: F.get(F.filter(m["effects"], lambda e: e["feature"] == name), 0)
        )
        return value(name, order, mine)

    return F.transform(literal_array(list(features)), one)


def best_feature(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add best_feat, new_risk, rank_feat, rank_val, rank_risk.

    best_feat has the lowest mean perturbed risk when that is below the mean original risk, else
    it is the first declared feature. rank_feat has the lowest coefficient sum; a model without a
    defined norm adds nothing. Ties go to the feature declared first.
    """
    sums = _per_feature(
        features,
        lambda name, order, mine: F.struct(
            (add_all(mine, lambda e: e["perturb_prob"]) / F.size(mine)).alias("risk"),
            add_all(mine, lambda e: F.coalesce(e["effect"], F.lit(0.0))).alias("total"),
            order.alias("order"),
            name.alias("feature"),
        ),
    )
    df = df.withColumn("__sums", sums)
    lowest = F.array_min("__sums")
    top = F.array_min(
        F.transform("__sums", lambda s: F.struct(s["total"], s["order"], s["feature"], s["risk"]))
    )
    first = F.get("__sums", 0)
    df = df.withColumns({"__low": lowest, "__top": top, "__risk": ensemble_risk()})
    helps = F.col("__low.risk") < F.col("__risk")
    found = F.struct(
        F.when(helps, F.col("__low.feature")).otherwise(first["feature"]).alias("best_feat"),
        F.when(helps, F.col("__low.risk")).otherwise(first["risk"]).alias("new_risk"),
        F.col("__top.feature").alias("rank_feat"),
        F.col("__top.total").alias("rank_val"),
        F.col("__top.risk").alias("rank_risk"),
    )
    scratch = ("__sums", "__low", "__top", "__risk")
    return df.select(*[c for c in df.columns if c not in scratch], unpacked(found))


def most_abnormal(features: Sequence[str]) -> Column:
    """The feature with the largest absolute scaled value; ties go to the first declared."""
    sizes = [
        F.struct(F.abs(F.col(f)).alias("size"), F.lit(-i).alias("order"), F.lit(f).alias("feature"))
        for i, f in enumerate(features)
    ]
    return F.array_max(F.array(*sizes))["feature"]


def threshold_count(
    ensemble: Column,
    models: Sequence[str],
    features: Sequence[str] | None = None,
    threshold: float = 0.5,
    direction: str = "above",
) -> Column:
    """Models with at least one perturbed probability beyond the threshold, 0 unless the
    ensemble risk exceeds it."""
    if direction not in ("above", "below"):
        raise ValueError("direction must be 'above' or 'below'")

    def beyond(e: Column) -> Column:
        p = e["perturb_prob"]
        hit = p > threshold if direction == "above" else p < threshold
        return hit if features is None else hit & e["feature"].isin(list(features))

    reached = F.filter(
        "panel", lambda m: m["model"].isin(list(models)) & F.exists(m["effects"], beyond)
    )
    return F.when(ensemble > threshold, F.size(reached)).otherwise(0)
