"""Effect coefficients: perturb one feature, rescore, take the logit difference.

The working layout is the *panel frame*, one row per (case, timepoint[, baseline]):

    panel ARRAY<STRUCT<model, orig_prob, effects ARRAY<STRUCT<feature, perturb_prob, effect>>>>

so norms, ranks, overlaps and votes are array expressions without any shuffle. ``effects_long``
explodes it to one row per perturbation, ``effects_wide`` gives one column per coefficient.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltframe.functions.scalar import add_all, base2_logit, literal_array
from tiltframe.operators.scaling import binary_columns
from tiltframe.operators.scorers import Scorer
from tiltframe.operators.values import within_length
from tiltframe.schemas import KEYS


@dataclass(frozen=True)
class Perturbation:
    """How one feature is changed: a swap of two values, or a move to ``epsilon``/a fraction."""

    feature: str
    low: float | None = None
    high: float | None = None
    epsilon: float = 0.0

    @property
    def binary(self) -> bool:
        return self.low is not None

    def apply(self, value: Column, baseline: Column | None = None) -> Column:
        if self.binary:
            return F.when(value == F.lit(self.low), F.lit(self.high)).otherwise(F.lit(self.low))
        full = F.lit(self.epsilon)
        if baseline is None:
            return full
        return F.when(baseline.isNull(), full).otherwise(value - value * baseline)


def perturbation_plan(
    df: DataFrame,
    features: Sequence[str],
    binary: dict[str, tuple[float, float]] | None = None,
    epsilon: float = 0.0,
) -> list[Perturbation]:
    """One perturbation per feature. ``binary`` declares the two-valued features and their
    values; without it they are found by an aggregate over the whole frame (one row per feature
    comes back)."""
    for field in df.select(*features).schema:
        if isinstance(field.dataType, T.StringType):
            raise ValueError(f"feature {field.name} is a string and cannot be perturbed")
    if binary is None:
        found = binary_columns(df, features).where("is_binary = 1").collect()
        binary = {row["feature"]: (row["low"], row["high"]) for row in found}
    plan = []
    for name in features:
        low, high = binary.get(name, (None, None))
        if low is not None and low == high:
            raise ValueError(f"feature {name} is constant and cannot be perturbed")
        plan.append(Perturbation(name, low, high, epsilon))
    return plan


def plan_table(df: DataFrame, features: Sequence[str], epsilon: float = 0.0) -> DataFrame:
    """The plan as a table: feature, action, low, high, epsilon."""
    return binary_columns(df, features).select(
        "feature",
        F.when(F.col("is_binary") == 1, "swap").otherwise("set").alias("action"),
        F.when(F.col("is_binary") == 1, F.col("low")).alias("low"),
        F.when(F.col("is_binary") == 1, F.col("high")).alias("high"),
        F.when(F.col("is_binary") == 0, F.lit(epsilon)).alias("epsilon"),
    )


def _with_baselines(df: DataFrame, baselines: Sequence[float | None] | None) -> DataFrame:
    if baselines is None:
        return df
    values = literal_array([None if b is None else float(b) for b in baselines])
    return df.withColumn("baseline", F.explode(values.cast("array<double>")))


# Variants scored in one projection.
BATCH = 16
# Model inputs, over all variants, that the last projection may score by itself; it has the same rows
# either way, but generated code must not outgrow its limits.
LATE = 128


def _entries(
    plan: Sequence[Perturbation],
    model: str,
    preprocess: Callable[[Column], Column],
    compare: Callable[[Column, Column], Column],
) -> Column:
    orig = F.col(f"__{model}_orig")
    effects = []
    for i, step in enumerate(plan):
        new = F.col(f"__{model}_{i}")
        effects.append(
            F.struct(
                F.lit(step.feature).alias("feature"),
                new.alias("perturb_prob"),
                compare(preprocess(orig), preprocess(new)).alias("effect"),
            )
        )
    return F.array(*effects)


def _panel_entry(model: str, effects: Column) -> Column:
    return F.struct(
        F.lit(model).alias("model"), F.col(f"__{model}_orig").alias("orig_prob"), effects.alias("effects")
    )


# Cells (models times features) up to which the operators on a panel name each of them.
NAMED_CELLS = 64


def _with_panel(df: DataFrame, kept: Sequence[str], panel: Column, models: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``kept`` and a panel whose column tells its models and features, as every row has the same."""
    return df.select(*kept, panel.alias("panel", metadata={"models": list(models), "features": list(features)}))


def panel_layout(df: DataFrame) -> tuple[list[str], list[str]] | None:
    """Models and features of the panel, in order, where its column tells them and they are few.

    With them an operator can name each cell. That is compiled, and a function over an array is not: it
    interprets its argument, too, down to the scores.
    """
    told = df.schema["panel"].metadata
    models, features = told.get("models", []), told.get("features", [])
    distinct = len(set(features)) == len(features)
    return (models, features) if distinct and 0 < len(models) * len(features) <= NAMED_CELLS else None


def static_effects(
    df: DataFrame,
    plan: Sequence[Perturbation],
    scorers: dict[str, Scorer],
    baselines: Sequence[float | None] | None = None,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = (),
    inputs: Sequence[str] | None = None,
    preprocess: Callable[[Column], Column] = base2_logit,
    compare: Callable[[Column, Column], Column] = lambda before, after: after - before,
) -> DataFrame:
    """Panel frame of models that score one row at a time: one row out for every row in.

    Variants are scored ``BATCH`` at a time and each batch is folded into the row before the next,
    so no projection grows with the number of features.

    ``baselines`` multiplies the rows: None moves a feature to its epsilon, a number b shrinks it
    to (1 - b) of its value. ``carry`` names extra columns to keep, ``inputs`` the model inputs
    when they are more than the perturbed features.
    """
    features = [step.feature for step in plan]
    inputs = list(inputs or features)
    rows = _with_baselines(df.select(*dict.fromkeys([*keys, *inputs, *carry])), baselines)
    baseline = F.col("baseline") if baselines is not None else None
    original = {f: F.col(f) for f in inputs}
    panel, late = [], 0
    for model, scorer in scorers.items():
        before, folded = f"__{model}_orig", f"__{model}_effects"
        for first in range(0, max(1, len(plan)), BATCH):
            batch = plan[first : first + BATCH]
            variants = {} if first else {before: original}
            for i, step in enumerate(batch):
                changed = step.apply(F.col(step.feature), baseline)
                variants[f"__{model}_{i}"] = {**original, step.feature: changed}
            rows = scorer.add_scores(rows, variants)
            effects = _entries(batch, model, preprocess, compare)
            effects = F.concat(F.col(folded), effects) if first else effects
            # A last batch may be folded where the panel is put together, which builds its array only once.
            late += (len(batch) + 1) * len(inputs)
            if first + BATCH < len(plan) or late > LATE:
                rows = rows.withColumn(folded, effects).drop(*(f"__{model}_{i}" for i in range(len(batch))))
                effects = F.col(folded)
        panel.append(_panel_entry(model, effects))
    kept = [*keys, *carry] + (["baseline"] if baselines is not None else [])
    return _with_panel(rows, kept, F.array(*panel), list(scorers), features)


def series_effects(
    df: DataFrame,
    plan: Sequence[Perturbation],
    scorers: dict[str, Callable[[Column], Column]],
    length: int,
    baselines: Sequence[float | None] | None = None,
    reverse: bool = True,
    inputs: Sequence[str] | None = None,
    preprocess: Callable[[Column], Column] = base2_logit,
    compare: Callable[[Column, Column], Column] = lambda before, after: after - before,
) -> DataFrame:
    """Panel frame of sequence models.

    A scorer maps a sequence ``ARRAY<STRUCT<features>>`` of exactly ``length`` steps to a
    probability (a Column expression, or a pandas_udf over the array). The sequence of a row is
    the history of its case up to and including its timepoint, earliest step first, padded with
    zero steps at the end; only the row's own step is perturbed. The rows of a case are counted before
    any history is gathered, and a case of more than ``length`` (the model's input length) fails the
    query; so ``length`` bounds every collected history.
    """
    features = [step.feature for step in plan]
    inputs = list(inputs or features)
    step_time = F.col("timepoint").desc() if reverse else F.col("timepoint").asc()
    past = Window.partitionBy("case").orderBy(step_time).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    step = lambda values: F.struct(*[values[f].cast("double").alias(f) for f in inputs])
    original = {f: F.col(f) for f in inputs}
    rows = within_length(df.select(*KEYS, *inputs), "case", length)
    gathered = F.collect_list(F.when(F.col("__within"), step(original))).over(past)
    rows = rows.select(*KEYS, *inputs, gathered.alias("__history"))
    if not reverse:  # steps are still laid out from the largest timepoint to the smallest
        rows = rows.withColumn("__history", F.reverse("__history"))
    rows = _with_baselines(rows, baselines)
    baseline = F.col("baseline") if baselines is not None else None
    zero = step({f: F.lit(0.0) for f in inputs})
    padding = F.array_repeat(zero, F.lit(length) - F.size("__history"))

    def sequence(last: Column | None) -> Column:
        if last is None:
            return F.concat(F.col("__history"), padding)
        rest = F.size("__history") - 1
        if reverse:
            return F.concat(F.slice("__history", F.lit(1), rest), F.array(last), padding)
        return F.concat(F.array(last), F.slice("__history", F.lit(2), rest), padding)

    columns = {}
    for model, scorer in scorers.items():
        columns[f"__{model}_orig"] = scorer(sequence(None))
        for i, change in enumerate(plan):
            new = {**original, change.feature: change.apply(F.col(change.feature), baseline)}
            columns[f"__{model}_{i}"] = scorer(sequence(step(new)))
    kept = list(KEYS) + (["baseline"] if baselines is not None else [])
    panel = [_panel_entry(m, _entries(plan, m, preprocess, compare)) for m in scorers]
    return _with_panel(rows.withColumns(columns), kept, F.array(*panel), list(scorers), features)


def normalize_effects(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Divide each model's coefficients of a row by their L2 norm; null when the norm is 0.

    With ``features`` only those coefficients enter the norm and are divided.
    """
    layout = panel_layout(df)
    if layout is not None:
        return _normalized_cells(df, *layout, list(features or layout[1]))
    chosen = (lambda e: e["feature"].isin(list(features))) if features else (lambda e: F.lit(True))
    with_norm = F.transform(
        "panel",
        lambda m: m.withField(
            "norm",
            F.sqrt(add_all(F.filter(m["effects"], chosen), lambda e: e["effect"] * e["effect"])),
        ),
    )
    scaled = lambda m: F.transform(
        m["effects"],
        lambda e: e.withField(
            "effect",
            F.when(chosen(e), F.try_divide(e["effect"], m["norm"])).otherwise(e["effect"]),
        ),
    )
    out = df.withColumn("panel", with_norm)
    return out.withColumn(
        "panel",
        F.transform(
            "panel",
            lambda m: F.struct(
                m["model"].alias("model"),
                m["orig_prob"].alias("orig_prob"),
                scaled(m).alias("effects"),
            ),
        ),
    )


def _normalized_cells(df: DataFrame, models: list[str], names: list[str], chosen: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != "panel"]
    entries = [f"__m{i}" for i in range(len(models))]
    df = df.select(*rest, *[F.get("panel", F.lit(i)).alias(entry) for i, entry in enumerate(entries)])
    cell = lambda entry, j: F.get(F.col(entry)["effects"], F.lit(j))
    norms = {}
    for entry in entries:
        effects = [cell(entry, j)["effect"] for j, f in enumerate(names) if f in chosen]
        norms[f"{entry}_norm"] = F.sqrt(sum((e * e for e in effects), F.lit(0.0)))
    df = df.withColumns(norms)

    def divided(entry: str) -> Column:
        cells = []
        for j, f in enumerate(names):
            e = cell(entry, j)
            effect = F.try_divide(e["effect"], F.col(f"{entry}_norm")) if f in chosen else e["effect"]
            cells.append(F.struct(e["feature"].alias("feature"), e["perturb_prob"].alias("perturb_prob"), effect.alias("effect")))
        return F.struct(
            F.col(entry)["model"].alias("model"), F.col(entry)["orig_prob"].alias("orig_prob"), F.array(*cells).alias("effects")
        )

    return _with_panel(df, rest, F.array(*[divided(entry) for entry in entries]), models, names)


def effects_long(df: DataFrame) -> DataFrame:
    """One row per (row, model, feature).

    The arrays are never empty, so the outer explode gives the same rows. The plain one would make
    the optimizer add a size check on the array and copy its whole expression below the scoring.
    """
    rest = [c for c in df.columns if c != "panel"]
    per_model = df.select(*rest, F.explode_outer("panel").alias("m"))
    per_effect = per_model.select(*rest, "m.model", "m.orig_prob", F.explode_outer("m.effects").alias("e"))
    return per_effect.select(
        *rest, "model", "e.feature", "orig_prob", "e.perturb_prob", "e.effect"
    )


def panel_from_long(
    effects: DataFrame, models: Sequence[str], features: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rebuild panel frames from stored long effects.

    Each group holds at most len(models) x len(features) values, so the gather is bounded.
    Rows that lack one of the models are dropped, as an inner join of the models would.
    """
    cell = {}
    for i, m in enumerate(models):
        is_m = F.col("model") == m
        cell[f"__{i}_orig"] = F.max(F.when(is_m, F.col("orig_prob")))
        for j, f in enumerate(features):
            here = is_m & (F.col("feature") == f)
            cell[f"__{i}_{j}_new"] = F.max(F.when(here, F.col("perturb_prob")))
            cell[f"__{i}_{j}_effect"] = F.max(F.when(here, F.col("effect")))
    chosen = effects.where(F.col("model").isin(list(models)) & F.col("feature").isin(list(features)))
    gathered = chosen.groupBy(*keys).agg(*[c.alias(n) for n, c in cell.items()])
    complete = gathered.dropna(subset=[f"__{i}_orig" for i in range(len(models))])
    panel = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.col(f"__{i}_orig").alias("orig_prob"),
                F.array(
                    *[
                        F.struct(
                            F.lit(f).alias("feature"),
                            F.col(f"__{i}_{j}_new").alias("perturb_prob"),
                            F.col(f"__{i}_{j}_effect").alias("effect"),
                        )
                        for j, f in enumerate(features)
                    ]
                ).alias("effects"),
            )
            for i, m in enumerate(models)
        ]
    )
    return complete.select(*keys, panel.alias("panel"))


def model_entry(model: str) -> Column:
    return F.get(F.filter("panel", lambda m: m["model"] == model), 0)


def effect_entry(entry: Column, feature: str) -> Column:
    return F.get(F.filter(entry["effects"], lambda e: e["feature"] == feature), 0)


def coefficient_name(model: str, feature: str) -> str:
    return f"{model}_{feature}"


def perturbed_name(model: str, feature: str) -> str:
    return f"perturb_{feature}_prob_{model}"


def original_name(model: str) -> str:
    return f"orig_prob_{model}"


def effects_wide(df: DataFrame, models: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One column per coefficient and probability, built inside the row (no pivot)."""
    rest = [c for c in df.columns if c != "panel"]
    found = df.select(*rest, *[model_entry(m).alias(f"__m{i}") for i, m in enumerate(models)])
    out = []
    for i, m in enumerate(models):
        entry = F.col(f"__m{i}")
        out.append(entry["orig_prob"].alias(original_name(m)))
        for f in features:
            effect = effect_entry(entry, f)
            out.append(effect["effect"].alias(coefficient_name(m, f)))
            out.append(effect["perturb_prob"].alias(perturbed_name(m, f)))
    return found.select(*rest, *out)


def join_model_effects(
    *panels: DataFrame,
    features: Sequence[str],
    data: DataFrame | None = None,
    labels: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Inner join of panel frames on the row key, restricted to ``features``; optionally with
    the feature values and the label."""
    if len(panels) < 2:
        raise ValueError("join needs the effects of at least two models")
    keep = lambda e: e["feature"].isin(list(features))
    out = None
    for panel in panels:
        kept = panel.select(
            *keys,
            F.transform(
                "panel", lambda m: m.withField("effects", F.filter(m["effects"], keep))
            ).alias("panel"),
        )
        if out is None:
            out = kept
        else:
            out = out.join(kept.withColumnRenamed("panel", "__other"), list(keys)).select(
                *keys, F.concat("panel", "__other").alias("panel")
            )
    for extra in (data, labels):
        if extra is not None:
            out = out.join(extra, list(keys))
    return out


def perturbation_sweep(
    df: DataFrame,
    plan: Sequence[Perturbation],
    scorers: dict[str, Scorer],
    baselines: Sequence[float | None] = (None, 0.5, 0.7, 0.9),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Normalized effects of every (model, baseline) as one job, long form.

    The rows multiply here, so a plan that one projection can score never becomes nested arrays: scores,
    norms and quotients are plain columns, and one generator deals them out.
    """
    if len(plan) > BATCH or (len(plan) + 1) * len(plan) * len(scorers) > LATE or not plan:
        return effects_long(normalize_effects(static_effects(df, plan, scorers, baselines, keys)))
    rows = _with_baselines(df.select(*dict.fromkeys([*keys, *(step.feature for step in plan)])), baselines)
    baseline = F.col("baseline") if baselines is not None else None
    original = {step.feature: F.col(step.feature) for step in plan}
    for model, scorer in scorers.items():
        variants = {f"__{model}_orig": original}
        for i, step in enumerate(plan):
            variants[f"__{model}_{i}"] = {**original, step.feature: step.apply(F.col(step.feature), baseline)}
        rows = scorer.add_scores(rows, variants)
    cells = [(model, i) for model in scorers for i in range(len(plan))]
    logits = {f"__{m}_l{i}": base2_logit(F.col(f"__{m}_{i}")) for m in scorers for i in ("orig", *range(len(plan)))}
    rows = rows.withColumns(logits)
    rows = rows.withColumns({f"__{m}_e{i}": F.col(f"__{m}_l{i}") - F.col(f"__{m}_lorig") for m, i in cells})
    squares = {m: [F.col(f"__{m}_e{i}") * F.col(f"__{m}_e{i}") for i in range(len(plan))] for m in scorers}
    rows = rows.withColumns({f"__{m}_norm": F.sqrt(sum(found, F.lit(0.0))) for m, found in squares.items()})
    entries = [
        F.struct(
            F.lit(m).alias("model"),
            F.lit(plan[i].feature).alias("feature"),
            F.col(f"__{m}_orig").alias("orig_prob"),
            F.col(f"__{m}_{i}").alias("perturb_prob"),
            F.try_divide(f"__{m}_e{i}", f"__{m}_norm").alias("effect"),
        )
        for m, i in cells
    ]
    kept = list(keys) + (["baseline"] if baselines is not None else [])
    return rows.select(*kept, F.inline_outer(F.array(*entries)))
