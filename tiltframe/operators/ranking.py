"""Top features per row and model, their frequencies and the agreement between models.

Everything that concerns one row works on the panel frame (see ``effects``) and adds columns:

    ranks   ARRAY<STRUCT<model, ranked ARRAY<STRUCT<rank, feature, effect>>>>
    rbos    ARRAY<STRUCT<model_a, model_b, rbo>>
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltframe.functions.overlap import rank_biased_overlap
from tiltframe.operators.effects import panel_layout
from tiltframe.schemas import NOT_FOUND


def rank_effects(
    df: DataFrame,
    rank: int = 3,
    models: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``ranks``: per model the ``rank`` most negative coefficients, best first.

    Equal coefficients rank the larger feature name first. A positive coefficient is a harmful
    change: its feature becomes 'not_found' with a null value, as does an undefined one (a row
    whose coefficients are all zero has no norm). Zero is kept.
    """
    if features is not None and rank > len(features):
        raise ValueError("rank exceeds the number of features")
    layout = panel_layout(df)
    every = layout is not None and set(models or layout[0]) >= set(layout[0]) and set(features or layout[1]) >= set(layout[1])
    if every:
        return _ranked_cells(df, len(layout[0]), len(layout[1]), rank)
    wanted = F.col("panel")
    if models is not None:
        wanted = F.filter(wanted, lambda m: m["model"].isin(list(models)))

    def ranked(entry: Column) -> Column:
        effects = entry["effects"]
        if features is not None:
            effects = F.filter(effects, lambda e: e["feature"].isin(list(features)))
        # Descending order of (gain, feature); null gains come last.
        gains = F.transform(
            effects, lambda e: F.struct((-e["effect"]).alias("gain"), e["feature"].alias("feature"))
        )
        top = F.slice(F.sort_array(gains, asc=False), 1, rank)
        return F.transform(
            top,
            lambda g, i: F.struct(
                (i + 1).alias("rank"),
                F.when(g["gain"] >= 0, g["feature"]).otherwise(NOT_FOUND).alias("feature"),
                F.when(g["gain"] >= 0, -g["gain"]).alias("effect"),
            ),
        )

    return df.withColumn(
        "ranks",
        F.transform(
            wanted, lambda m: F.struct(m["model"].alias("model"), ranked(m).alias("ranked"))
        ),
    )


def _ranked_cells(df: DataFrame, n_models: int, n_features: int, rank: int) -> DataFrame:
    tops = {}
    for i in range(n_models):
        effects = F.get("panel", F.lit(i))["effects"]
        cells = [F.get(effects, F.lit(j)) for j in range(n_features)]
        gains = F.array(*[F.struct((-e["effect"]).alias("gain"), e["feature"].alias("feature")) for e in cells])
        tops[f"__top{i}"] = F.sort_array(gains, asc=False)
    df = df.withColumns(tops)

    def place(top: str, r: int) -> Column:
        g = F.get(top, F.lit(r))
        return F.struct(
            F.lit(r + 1).alias("rank"),
            F.when(g["gain"] >= 0, g["feature"]).otherwise(NOT_FOUND).alias("feature"),
            F.when(g["gain"] >= 0, -g["gain"]).alias("effect"),
        )

    entries = [
        F.struct(
            F.get("panel", F.lit(i))["model"].alias("model"),
            F.array(*[place(top, r) for r in range(min(rank, n_features))]).alias("ranked"),
        )
        for i, top in enumerate(tops)
    ]
    return df.withColumn("ranks", F.array(*entries)).drop(*tops)


def ranks_long(df: DataFrame) -> DataFrame:
    """One row per (row, model, rank)."""
    rest = [c for c in df.columns if c not in ("panel", "ranks", "rbos")]
    per_model = df.select(*rest, F.explode_outer("ranks").alias("m"))
    return per_model.select(*rest, F.col("m.model"), F.inline_outer("m.ranked"))


def ranks_wide(df: DataFrame, models: Sequence[str], rank: int) -> DataFrame:
    """{model}_effect_{r}, {model}_feat_{r}; without the suffix when rank is 1."""
    rest = [c for c in df.columns if c not in ("panel", "ranks", "rbos")]
    out = []
    for m in models:
        entry = F.get(F.filter("ranks", lambda r: r["model"] == m), 0)
        for r in range(rank, 0, -1):
            item = F.get(entry["ranked"], r - 1)
            suffix = "" if rank == 1 else f"_{r}"
            out.append(item["effect"].alias(f"{m}_effect{suffix}"))
            out.append(item["feature"].alias(f"{m}_feat{suffix}"))
    return df.select(*rest, *out)


def _found(ranked: Column) -> Column:
    kept = F.filter(ranked, lambda r: r["feature"] != NOT_FOUND)
    return F.transform(kept, lambda r: r["feature"])


def ranked_features(model: str) -> Column:
    """The ranked list of one model without 'not_found'."""
    return _found(F.get(F.filter("ranks", lambda r: r["model"] == model), 0)["ranked"])


def model_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    """(later, earlier) pairs in sorted model order."""
    names = sorted(models)
    return [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i > j]


def with_rbos(
    df: DataFrame, models: Sequence[str], depth: int, p: float = 0.9, name: str = "rbos"
) -> DataFrame:
    """Add the overlap of every model pair of the row; ``depth`` is the rank depth in use."""
    lists = {m: f"__list_{m}" for m in models}
    df = df.withColumns({col: ranked_features(m) for m, col in lists.items()})
    pairs = [
        F.struct(
            F.lit(a).alias("model_a"),
            F.lit(b).alias("model_b"),
            rank_biased_overlap(
                F.col(lists[a]), F.col(lists[b]), p=p, check=False
            ).alias("rbo"),
        )
        for a, b in model_pairs(models)
    ]
    return df.withColumn(name, F.array(*pairs)).drop(*lists.values())


def mean_rbo(column: str = "rbos") -> Column:
    """Mean overlap of the model pairs of a row."""
    return F.aggregate(
        column, F.lit(0.0), lambda acc, r: acc + r["rbo"], lambda acc: acc / F.size(column)
    )


def pairwise_model_rbo(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Ranked lists and one column per model pair, e.g. mlp_lr."""
    rest = [c for c in df.columns if c not in ("panel", "ranks", "rbos")]
    pairs = model_pairs(models)
    return df.select(
        *rest,
        *[ranked_features(m).alias(f"{m}_ranked") for m in sorted(models)],
        *[F.get("rbos", i)["rbo"].alias(f"{a}_{b}") for i, (a, b) in enumerate(pairs)],
    )


def rbo_summary(
    df: DataFrame, models: Sequence[str], depth: int, ps: Sequence[float] = (0.9, 0.95, 1.0)
) -> DataFrame:
    """Mean and sample deviation of the overlap per model pair and p, in one pass."""
    for i, p in enumerate(ps):
        df = with_rbos(df, models, depth, p, f"__rbos{i}")
    tagged = [
        F.transform(f"__rbos{i}", lambda r: r.withField("p", F.lit(float(p))))
        for i, p in enumerate(ps)
    ]
    rows = df.select(F.explode_outer(F.concat(*tagged)).alias("r")).select("r.*")
    return rows.groupBy("model_a", "model_b", "p").agg(
        F.avg("rbo").alias("mean_rbo"), F.stddev_samp("rbo").alias("std_rbo")
    )


def rank_frequency(ranks: DataFrame) -> DataFrame:
    """How often each feature holds each rank, per model (input: ``ranks_long``)."""
    return ranks.groupBy("model", "rank", "feature").agg(F.count("*").alias("n"))


def winner_frequency(winners: DataFrame, label: str = "CON@1") -> DataFrame:
    """How often each feature wins the vote, under a policy name; rows without winner are left out."""
    counts = winners.where(F.col("winner").isNotNull()).groupBy("winner")
    return counts.agg(F.count("*").alias("n")).withColumn("policy", F.lit(label))
