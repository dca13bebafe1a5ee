"""Report tables over effects, ranks and votes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltframe.functions.scalar import add_all, literal_array
from tiltframe.schemas import NOT_FOUND


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("panel", "ranks", "rbos", "vote")]


def case_effect_stats(df: DataFrame) -> DataFrame:
    """model, feature, effect, risk, risk_new and percent risk reduction of every row."""
    per_model = df.select(*_rest(df), F.explode_outer("panel").alias("m"))
    rows = per_model.select(
        *_rest(df), "m.model", F.col("m.orig_prob").alias("risk"), F.explode_outer("m.effects").alias("e")
    )
    return rows.select(
        *_rest(df),
        "model",
        "e.feature",
        "e.effect",
        "risk",
        F.col("e.perturb_prob").alias("risk_new"),
        (F.try_divide(F.col("risk") - F.col("e.perturb_prob"), F.col("risk")) * 100.0).alias(
            "risk_prc_reduct"
        ),
    )


def _entries_of(feature: Column) -> Column:
    return F.transform(
        "panel", lambda m: F.get(F.filter(m["effects"], lambda e: e["feature"] == feature), 0)
    )


def top_features_by_risk(df: DataFrame, features: Sequence[str], limit: int) -> DataFrame:
    """Per row the ``limit`` features with the lowest mean new risk (ties: smaller name)."""

    def mean_risk(name: Column) -> Column:
        mine = _entries_of(name)
        return F.struct(
            (add_all(mine, lambda e: e["perturb_prob"]) / F.size(mine)).alias("risk_new"),
            name.alias("feature"),
        )

    top = F.slice(F.sort_array(F.transform(literal_array(list(features)), mean_risk)), 1, limit)
    return df.select(*_rest(df), F.posexplode_outer(top).alias("position", "t")).select(
        *_rest(df), (F.col("position") + 1).alias("position"), "t.feature", "t.risk_new"
    )


def panel_table(
    df: DataFrame,
    models: Sequence[str],
    features: Sequence[str],
    ensemble: str | None = None,
    total: bool = True,
) -> DataFrame:
    """Coefficient per row, model and feature to 3 decimals, and a SUM row of the rounded values
    to 2 decimals. The model named ``ensemble`` is left out. Sums are taken in decimal, so a sum
    that ends in 5 rounds the same way everywhere."""
    shown = [m for m in models if m != ensemble]
    cells = F.flatten(
        F.transform(
            F.filter("panel", lambda m: m["model"].isin(shown)),
            lambda m: F.transform(
                F.filter(m["effects"], lambda e: e["feature"].isin(list(features))),
                lambda e: F.struct(
                    F.upper(m["model"]).alias("model"),
                    e["feature"].alias("feature"),
                    F.round(e["effect"], 3).cast("decimal(18,3)").alias("value"),
                ),
            ),
        )
    )
    df = df.select(*_rest(df), cells.alias("__cells"))
    sums = F.transform(
        literal_array(list(features)),
        lambda f: F.struct(
            F.lit("SUM").alias("model"),
            f.alias("feature"),
            F.round(
                F.aggregate(
                    F.filter("__cells", lambda c: c["feature"] == f),
                    F.lit(0).cast("decimal(18,3)"),
                    lambda acc, c: (acc + c["value"]).cast("decimal(18,3)"),
                ),
                2,
            )
            .cast("decimal(18,3)")
            .alias("value"),
        ),
    )
    rows = F.concat("__cells", sums) if total else F.col("__cells")
    out = df.select(*[c for c in df.columns if c != "__cells"], F.inline_outer(rows))
    return out.withColumn("value", F.col("value").cast("double"))


def _heatmap(rows: DataFrame, by: str, timepoint: int) -> DataFrame:
    times = list(range(timepoint + 1))
    counted = (
        rows.where(F.col("timepoint") <= timepoint)
        .where(F.col(by).isNotNull())
        .groupBy(by)
        .pivot("timepoint", times)
        .agg(F.count(F.lit(1)))
    )
    return counted.select(
        by, *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast("bigint").alias(f"t{t}") for t in times]
    )


def rank_heatmap(ranks: DataFrame, model: str, timepoint: int = 10) -> DataFrame:
    """Cases per (top feature, timepoint) of one model up to ``timepoint`` (from ``ranks_long``)."""
    first = ranks.where((F.col("model") == model) & (F.col("rank") == 1))
    return _heatmap(first, "feature", timepoint)


def consensus_heatmap(votes: DataFrame, timepoint: int = 10) -> DataFrame:
    """Cases per (winner, timepoint) up to ``timepoint``."""
    return _heatmap(votes, "winner", timepoint)


def policy_table(
    top_ranks: DataFrame,
    winners: dict[str, DataFrame],
    models: Sequence[str],
    features: Sequence[str],
) -> DataFrame:
    """feature x {each model, each voting policy}: how often it comes first, 0 when never.

    ``top_ranks`` holds rank-1 rows (model, feature), ``winners`` maps a policy to its votes.
    """
    counted = [
        top_ranks.groupBy("model", "feature")
        .agg(F.count("*").alias("n"))
        .select(F.col("model").alias("policy"), "feature", "n")
    ]
    for policy, votes in winners.items():
        counted.append(
            votes.groupBy(F.col("winner").alias("feature"))
            .agg(F.count("*").alias("n"))
            .select(F.lit(policy).alias("policy"), "feature", "n")
        )
    names = [*features, NOT_FOUND]
    listed = top_ranks.sparkSession.range(1).select(
        F.lit(models[0]).alias("policy"),
        F.explode(literal_array(names)).alias("feature"),
        F.lit(0).cast("bigint").alias("n"),
    )
    rows = reduce(DataFrame.unionByName, [*counted, listed]).where(F.col("feature").isin(names))
    policies = [*models, *winners]
    return rows.groupBy("feature").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("policy") == p, F.col("n"))), F.lit(0))
            .cast("bigint")
            .alias(p)
            for p in policies
        ]
    )


def panel_overlap_comparison(panels: dict[str, DataFrame]) -> DataFrame:
    """Mean overlap by winner and panel; winners are numbered by their frequency over all panels.

    Inputs have (winner, rbo). Only one row per winner and panel reaches the numbering.
    """
    parts = []
    for name, votes in panels.items():
        parts.append(
            votes.where(F.col("winner").isNotNull())
            .groupBy("winner")
            .agg(F.count("*").alias("n"), F.avg("rbo").alias("mean_rbo"))
            .withColumn("panel", F.lit(name))
        )
    rows = reduce(DataFrame.unionByName, parts)
    order = (
        rows.groupBy("winner")
        .agg(F.sum("n").alias("n_all"))
        .withColumn(
            "position", F.row_number().over(Window.orderBy(F.col("n_all").desc(), "winner"))
        )
    )
    return rows.join(order, "winner").select("winner", "panel", "n", "mean_rbo", "n_all", "position")


def sensitivity_counts(
    votes: DataFrame, numeric_features: Sequence[str], top_k: int | None = None
) -> DataFrame:
    """Winner counts by perturbation size and label over the non-boolean winners, for the
    ``top_k`` winners of the full perturbation at label 1.

    ``votes`` has (winner, baseline, label); a null baseline is the full perturbation. The raw
    rows are aggregated once; ranking the winners only touches the counts.
    """
    counts = (
        votes.where(F.col("winner").isin(list(numeric_features)))
        .groupBy(
            "winner",
            F.coalesce(F.col("baseline").cast("string"), F.lit("full")).alias("perturb"),
            "label",
        )
        .agg(F.count("*").alias("n"))
    )
    base = counts.where((F.col("perturb") == "full") & (F.col("label") == 1))
    order = base.select(
        "winner",
        F.row_number().over(Window.orderBy(F.col("n").desc(), "winner")).alias("position"),
    )
    if top_k is not None:
        order = order.where(F.col("position") <= top_k)
    return counts.join(order, "winner").select("winner", "perturb", "label", "n", "position")


def importance_comparison(votes: DataFrame, attribution: DataFrame) -> DataFrame:
    """Per label: how often a feature wins, its mean attribution, and its position in both orders.

    ``votes`` has (winner, label), ``attribution`` (label, feature, mean_abs).
    """
    counts = (
        votes.where(F.col("winner").isNotNull())
        .groupBy("label", F.col("winner").alias("feature"))
        .agg(F.count("*").alias("n"))
    )
    by_votes = Window.partitionBy("label").orderBy(F.col("n").desc(), "feature")
    by_size = Window.partitionBy("label").orderBy(F.col("mean_abs").desc(), "feature")
    return (
        counts.withColumn("vote_position", F.row_number().over(by_votes))
        .join(
            attribution.withColumn("attribution_position", F.row_number().over(by_size)),
            ["label", "feature"],
        )
        .select("label", "feature", "n", "vote_position", "mean_abs", "attribution_position")
    )


def case_timeline(df: DataFrame, raw: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per case hour: ensemble risk, best feature, its raw value, new risk, and whether changing
    it brings a risk above one half below one half.

    ``df`` has best_feat, new_risk and orig_prob_ensemble; ``raw`` the unscaled features.
    """
    values = raw.select("case", "timepoint", *[F.col(f).alias(f"__raw_{f}") for f in features])
    value = F.coalesce(
        *[F.when(F.col("best_feat") == f, F.col(f"__raw_{f}").cast("double")) for f in features]
    )
    crosses = (F.col("new_risk") < 0.5) & (F.col("orig_prob_ensemble") > 0.5)
    return df.join(values, ["case", "timepoint"]).select(
        "case",
        "timepoint",
        "orig_prob_ensemble",
        "best_feat",
        value.alias("best_value"),
        "new_risk",
        (crosses & value.isNotNull()).cast("int").alias("crosses_half"),
    )
