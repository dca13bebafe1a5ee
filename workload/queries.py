"""One query per operator over the whole given tables.

Library results are exact; only here, at the edge, doubles are rounded so that two engines can be
compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltframe.functions.overlap import (
    average_overlap,
    rank_biased_overlap,
    rank_biased_overlap_uneven,
    top_weight,
)
from tiltframe.functions.scalar import base2_logit
from tiltframe.operators import attribution, comorbidity, measurements, records, training, visits
from tiltframe.operators import consensus as votes
from tiltframe.operators import effects as fx
from tiltframe.operators import metrics, profiling, ranking, reports, scaling, scorers, split, values
from tiltframe.operators.ventilation import ventilation_episodes
from tiltframe.plans import extraction, fitted, panel, series
from tiltframe.session import new_table_path, tune, tune_events
from tiltframe.sources import delimited, tables
from workload import fixtures as data
from workload.fixtures import DAY_FEATURES, MODELS, ORDER_FEATURES, SCALED_FEATURES, SCORERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYS = ["case", "timepoint"]
BINARY = {"returned": (0.0, 1.0)}
PLAN = [
    fx.Perturbation(f, *BINARY.get(f, (None, None))) for f in ORDER_FEATURES
]
WEIGHTS = {"lr": 0.7, "mlp": 0.9, "rf": None}
SWEEP = [None, 0.5, 0.7, 0.9]
WINDOW_AND_LEAD, LEAD, MIN_HOURS = 27, 3, 27


def query(name: str, digits: int = 6, events: bool = False):
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return rounded(build(tune_events(spark) if events else tune(spark), sf), digits)

        QUERIES[name] = run
        return build

    return register


# Percentages are a hundred times larger, so two digits less are comparable.
PERCENT = ("avg_percent_consensus", "avg_percent_all", "risk_prc_reduct")


def rounded(df: DataFrame, digits: int) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    places = {c: digits - 2 if c in PERCENT else digits for c in doubles}
    return df.withColumns({c: _half_up(F.col(f"`{c}`"), n) for c, n in places.items()})


def _half_up(value, digits: int):
    """``F.round`` of a double, which goes through decimal texts, only where plain arithmetic could differ:
    near a half, for large numbers and for those that are not finite."""
    scaled = value * F.lit(10.0**digits)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - whole) < 0.499)
    return F.when(plain, whole / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(value, digits))


# --- shared inputs ----------------------------------------------------------------------------
def scaled(spark, sf):
    return data.scaled_order_features(spark, sf)


def raw_effects(spark, sf, baselines=None):
    return fx.static_effects(scaled(spark, sf), PLAN, SCORERS, baselines, carry=["label"])


def norm_effects(spark, sf, baselines=None):
    return fx.normalize_effects(raw_effects(spark, sf, baselines))


def ranked(spark, sf, rank=5, baselines=None):
    return ranking.rank_effects(norm_effects(spark, sf, baselines), rank, MODELS, ORDER_FEATURES)


def with_overlaps(spark, sf, p=0.9, rank=5):
    return ranking.with_rbos(ranked(spark, sf, rank), MODELS, rank, p)


def voted(spark, sf, rank=5, weights=None, policy="sum", baselines=None):
    return votes.with_consensus(ranked(spark, sf, rank, baselines), ORDER_FEATURES, weights, policy)


# Averages of the same values in another order differ in the last bit. Scores are compared after
# dropping those bits, so that tied rows are tied in both engines.
SCORE_DIGITS = 12


def scores(spark, sf):
    rows = scorers.score_long(scaled(spark, sf), ORDER_FEATURES, SCORERS, ["case", "label"])
    return rows.withColumn("prob", F.round("prob", SCORE_DIGITS))


def wide_scores(spark, sf):
    rows = scorers.score_rows(scaled(spark, sf), ORDER_FEATURES, SCORERS)
    return rows.withColumns({f"prob_{m}": F.round(f"prob_{m}", SCORE_DIGITS) for m in MODELS})


def filled_days(spark, sf):
    """The daily panel: forward filled, standardized by the known values, then missing ones set to
    the mean, which is 0 in these units."""
    filled = values.forward_fill_series(data.user_days(spark, sf), DAY_FEATURES)
    scaled_days = scaling.Scaler.fit(filled, DAY_FEATURES).transform(filled)
    return scaling.impute(scaled_days, [], DAY_FEATURES)


def day_effects(spark, sf):
    plan = [fx.Perturbation(f) for f in DAY_FEATURES]
    return fx.normalize_effects(
        fx.static_effects(filled_days(spark, sf), plan, data.DAY_SCORERS, carry=["outcome"])
    )


def joined_names(column: str):
    return F.array_join(column, ",")


# --- sources and sinks ------------------------------------------------------------------------
@query("read_study_table")
def _(spark, sf):
    study = tables.read_study_table(spark, f"{sf}/events.parquet")
    return study.select("event_id", "ts", "user_id", "event_type", "value")


CSV_SCHEMA = T.StructType(
    [T.StructField("case", T.LongType())]
    + [T.StructField(f, T.DoubleType()) for f in ORDER_FEATURES]
    + [T.StructField("label", T.IntegerType())]
)


@query("read_feature_csv")
def _(spark, sf):
    path = new_table_path(spark, "features-csv")
    rows = data.order_features(spark, sf).select("case", *ORDER_FEATURES, "label")
    delimited.write_feature_csv(rows, path)
    return delimited.read_feature_csv(spark, path, CSV_SCHEMA)


@query("replace_table")
def _(spark, sf):
    path = new_table_path(spark, "user-days")
    return tables.replace_table(data.user_days(spark, sf), path)


@query("write_sweep_csv")
def _(spark, sf):
    path = new_table_path(spark, "sweep-csv")
    sweep = fx.perturbation_sweep(scaled(spark, sf), PLAN, SCORERS, SWEEP)
    delimited.write_sweep_csv(sweep, path)
    schema = T.StructType(
        [T.StructField("case", T.LongType()), T.StructField("timepoint", T.IntegerType())]
        + [T.StructField("feature", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("orig_prob", "perturb_prob", "effect")]
        + [T.StructField(c, T.StringType()) for c in ("model", "perturb")]
    )
    return delimited.read_sweep_csv(spark, path, schema)


def forced_ids(spark, sf):
    """A saved id list: the documents labelled as good."""
    return data.table(spark, sf, "labels").where("quality = 1").select("doc_id")


@query("forced_validation_ids")
def _(spark, sf):
    cases = data.order_features(spark, sf).select("case")
    return tables.forced_validation_ids(cases, forced_ids(spark, sf))


# --- cohort and events ------------------------------------------------------------------------
def _clinical(spark, sf) -> extraction.BaseTables:
    return extraction.BaseTables(
        icustays=data.icustays(spark, sf),
        admissions=data.admissions(spark, sf),
        patients=data.patients(spark, sf),
        services=data.services(spark, sf),
        chartevents=data.chartevents(spark, sf),
        procedures=data.procedures(spark, sf),
        labevents=data.labevents(spark, sf),
        diagnoses=data.diagnoses(spark, sf),
    )


def cohort(spark, sf):
    return extraction.cohort(_clinical(spark, sf), MIN_HOURS)


def stored(spark, df, name):
    """Write a small derived table once and read it back, as the cohort is published between the
    steps of the extraction; the steps that follow do not recompute it."""
    return tables.replace_table(df, new_table_path(spark, name))


def event_times(spark, sf):
    users = visits.event_users(cohort(spark, sf))
    events = visits.event_time_assignment(data.icustays(spark, sf), users, WINDOW_AND_LEAD)
    return stored(spark, events, "events")


@query("service_moves")
def _(spark, sf):
    return visits.service_moves(data.services(spark, sf))


@query("notes_before_event", events=True)
def _(spark, sf):
    events = event_times(spark, sf)
    notes = data.noteevents(spark, sf)
    near = records.notes_before_event(notes, events, 48).withColumn("form", F.lit("48h"))
    older = records.notes_before_event(notes, events).withColumn("form", F.lit("any"))
    return near.unionByName(older)


@query("meds_before_event", events=True)
def _(spark, sf):
    events = event_times(spark, sf)
    drugs = data.prescriptions(spark, sf)
    near = records.meds_before_event(drugs, events, 48).withColumn("form", F.lit("48h"))
    older = records.meds_before_event(drugs, events).withColumn("form", F.lit("any"))
    return near.unionByName(older)


def demographics(spark, sf):
    return visits.stay_demographics(
        data.icustays(spark, sf), data.admissions(spark, sf), data.patients(spark, sf)
    )


@query("stay_demographics", events=True)
def _(spark, sf):
    return demographics(spark, sf)


@query("clean_demographics", events=True)
def _(spark, sf):
    return visits.clean_demographics(demographics(spark, sf), MIN_HOURS)


@query("ventilation_episodes", events=True)
def _(spark, sf):
    return ventilation_episodes(data.chartevents(spark, sf), data.procedures(spark, sf))


@query("comorbidity_flags")
def _(spark, sf):
    return comorbidity.comorbidity_flags(data.diagnoses(spark, sf), data.admissions(spark, sf))


@query("event_time_assignment", events=True)
def _(spark, sf):
    users = visits.event_users(cohort(spark, sf))
    return visits.event_time_assignment(data.icustays(spark, sf), users, WINDOW_AND_LEAD)


@query("first_labs_before_event", events=True)
def _(spark, sf):
    return measurements.first_labs_before_event(
        event_times(spark, sf), data.labevents(spark, sf), LEAD
    )


@query("hourly_vitals_labs", events=True)
def _(spark, sf):
    return measurements.hourly_vitals_labs(
        event_times(spark, sf),
        data.labevents(spark, sf),
        data.chartevents(spark, sf),
        WINDOW_AND_LEAD,
        LEAD,
    )


@query("first_day_labs", events=True)
def _(spark, sf):
    return measurements.first_day_labs(data.icustays(spark, sf), data.labevents(spark, sf), 24)


@query("first_day_vitals", events=True)
def _(spark, sf):
    return measurements.first_day_vitals(
        data.icustays(spark, sf), data.chartevents(spark, sf), 24
    )


@query("cohort_selection", events=True)
def _(spark, sf):
    return cohort(spark, sf)


@query("study_table", events=True)
def _(spark, sf):
    selected = stored(spark, cohort(spark, sf), "cohort")
    return extraction.study(
        _clinical(spark, sf), MIN_HOURS, WINDOW_AND_LEAD, LEAD, selected=selected
    )


STUDY_FEATURES = ["heartrate_mean", "sysbp_mean", "tempc_mean", "albumin", "creatinine"]


def _study_risk(v):
    score = 0.3 * v["heartrate_mean"] - 0.2 * v["sysbp_mean"] + 0.1 * v["tempc_mean"] - 0.4 * v["albumin"] + 0.5 * v["creatinine"]
    return 1.0 / (1.0 + F.exp(-(score - 0.3)))


@query("study_to_sweep", events=True)
def _(spark, sf):
    """From the base tables to the effects of every perturbation size on every selected stay."""
    selected = stored(spark, cohort(spark, sf), "cohort")
    study = extraction.study(_clinical(spark, sf), MIN_HOURS, WINDOW_AND_LEAD, LEAD, selected=selected)
    return series.study_sweep(study, STUDY_FEATURES, {"risk": scorers.ColumnScorer(_study_risk)}, SWEEP)


@query("case_lookup")
def _(spark, sf):
    return visits.case_lookup(data.admissions(spark, sf), 7)


@query("note_digest")
def _(spark, sf):
    return records.note_digest(data.noteevents(spark, sf))


@query("cohort_profile", events=True)
def _(spark, sf):
    clean = visits.clean_demographics(demographics(spark, sf), MIN_HOURS)
    clean = stored(spark, clean, "demographics")
    selected = extraction.cohort(_clinical(spark, sf), MIN_HOURS, demo=clean)
    chosen = stored(spark, selected.select("subject_id", "ventnum"), "cohort")
    columns = [
        "adult_icu", "age", "admission_type", "ethnicity", "diagnosis", "first_hosp_stay",
        "first_icu_stay", "mort_icu",
    ]
    return profiling.cohort_profile(
        {
            "services": (data.services(spark, sf), ["curr_service"]),
            "demographics": (clean.withColumn("age", F.col("age").cast("int")), columns),
            "cohort": (chosen, ["ventnum"]),
        },
        "subject_id",
    )


# --- features ---------------------------------------------------------------------------------
@query("last_value_features")
def _(spark, sf):
    return values.last_value_features(data.user_days(spark, sf), DAY_FEATURES, "outcome")


@query("first_last_features")
def _(spark, sf):
    return values.first_last_features(
        data.user_days(spark, sf), ["view_mean", "click_mean"], ["purchase_mean", "signup_mean"],
        "outcome",
    )


@query("forward_fill_series")
def _(spark, sf):
    return values.forward_fill_series(data.user_days(spark, sf), DAY_FEATURES)


@query("split_by_case")
def _(spark, sf):
    cases = data.order_features(spark, sf).select("case")
    free = split.with_split(cases, name="is_valid")
    forced = split.with_split(cases, forced_valid=forced_ids(spark, sf), name="is_valid_forced")
    return free.join(forced, "case")


@query("impute_mean_zero")
def _(spark, sf):
    train, valid = split.split_by_case(data.user_days(spark, sf))
    parts = [
        scaling.impute(part, DAY_FEATURES[:3], DAY_FEATURES[3:]).withColumn("side", F.lit(side))
        for side, part in (("train", train), ("valid", valid))
    ]
    return parts[0].unionByName(parts[1])


@query("impute_zero_as_missing")
def _(spark, sf):
    return scaling.impute_zero_as_missing(
        data.order_features(spark, sf), ORDER_FEATURES, exempt=["returned"]
    )


@query("standardize")
def _(spark, sf):
    train, valid = split.split_by_case(data.order_features(spark, sf))
    fitted = scaling.Scaler.fit(train, SCALED_FEATURES)
    return (
        fitted.transform(train)
        .withColumn("side", F.lit("train"))
        .unionByName(fitted.transform(valid).withColumn("side", F.lit("valid")))
    )


@query("unscale")
def _(spark, sf):
    rows = data.order_features(spark, sf)
    fitted = scaling.Scaler.fit(rows, SCALED_FEATURES)
    return fitted.inverse(fitted.transform(rows), digits=6)


@query("binary_columns")
def _(spark, sf):
    return scaling.binary_columns(data.order_features(spark, sf), [*ORDER_FEATURES, "label"])


@query("sequence_pad")
def _(spark, sf):
    days = data.user_days(spark, sf).fillna(0.0, subset=DAY_FEATURES)
    padded = values.sequence_pad(days, DAY_FEATURES, label="outcome")
    steps = F.arrays_zip(*DAY_FEATURES)
    return padded.select("case", "label", F.posexplode_outer(steps).alias("position", "s")).select(
        "case", "label", "position", *[F.col(f"s.{f}").alias(f) for f in DAY_FEATURES]
    )


@query("series_split")
def _(spark, sf):
    """Both sides of the split as padded sequences, standardized by the training side."""
    sides = series.series_sides(data.user_days(spark, sf), DAY_FEATURES, "outcome")
    steps = F.arrays_zip(*DAY_FEATURES)
    return sides.select("case", "is_valid", "label", F.posexplode_outer(steps).alias("position", "s")).select(
        "case", "is_valid", "label", "position", *[F.col(f"s.{f}").alias(f) for f in DAY_FEATURES]
    )


@query("series_slice")
def _(spark, sf):
    days = data.user_days(spark, sf)
    past = values.series_slice(days, 10).withColumn("side", F.lit("past"))
    rest = values.series_slice(days, 10, reverse=False).withColumn("side", F.lit("rest"))
    return past.unionByName(rest)


@query("category_columns")
def _(spark, sf):
    parts = values.category_columns(
        data.table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]
    )
    orders = values.category_columns(
        data.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_totalprice"]
    )
    return parts.unionByName(orders)


@query("class_weights")
def _(spark, sf):
    return scaling.class_weights(data.order_features(spark, sf))


@query("case_keys")
def _(spark, sf):
    rows = data.order_features(spark, sf).withColumnRenamed("case", "row_key")
    return values.case_keys(rows, "row_key", [*ORDER_FEATURES, "row_key"])


@query("distribution_fit")
def _(spark, sf):
    fit = profiling.distribution_fit(data.order_features(spark, sf), SCALED_FEATURES)
    return fit.withColumn("variance", F.round("variance", 3))


@query("histogram_density")
def _(spark, sf):
    rows = split.with_split(data.order_features(spark, sf))
    return profiling.histogram_density(rows, ["qty", "returned"], by=["is_valid"])


@query("top_abs_correlations")
def _(spark, sf):
    rows = profiling.effects_with_features(
        fx.effects_wide(norm_effects(spark, sf).drop("label"), ["lr"], ORDER_FEATURES),
        scaled(spark, sf),
        "lr",
        ORDER_FEATURES,
    )
    columns = [c for c in rows.columns if c not in KEYS]
    return profiling.top_abs_correlations(rows, columns, 5)


@query("effects_with_features")
def _(spark, sf):
    wide = fx.effects_wide(norm_effects(spark, sf).drop("label"), ["lr"], ORDER_FEATURES)
    return profiling.effects_with_features(wide, scaled(spark, sf), "lr", ORDER_FEATURES)


# --- models -----------------------------------------------------------------------------------
@query("score_probability")
def _(spark, sf):
    return scores(spark, sf)


def _forest(rows):
    return training.train_forest_calibrated(rows, ORDER_FEATURES, trees=100)


FITS = {
    "train_logistic": {
        "plain": lambda rows: training.train_logistic(rows, ORDER_FEATURES),
        "balanced": lambda rows: training.train_logistic(rows, ORDER_FEATURES, balanced=True),
    },
    "train_forest_calibrated": {"rf": _forest},
    "train_mlp": {
        f"mlp{i}": (
            lambda rows, seed=seed: training.train_mlp(
                rows, ORDER_FEATURES, seed, balanced=True
            )
        )
        for i, seed in enumerate((123, 321, 231), start=1)
    },
    "train_svm_calibrated": {"svm": lambda rows: training.train_svm_calibrated(rows, ORDER_FEATURES)},
    "train_boosted_trees": {
        "gbt": lambda rows: training.train_boosted_trees(rows, ORDER_FEATURES)
    },
}


def _trained(fits):
    """Fit on the training cases, score the validation cases."""

    def run(spark, sf):
        # Iterative fits read the training rows many times: store the matrix once.
        rows = stored(spark, scaled(spark, sf), "training")
        train, valid = split.split_by_case(rows)
        fitted = {name: fit(train) for name, fit in fits.items()}
        return scorers.score_long(valid, ORDER_FEATURES, fitted, ["case", "label"])

    return run


for _name, _fits in FITS.items():
    query(_name)(_trained(_fits))


@query("soft_vote")
def _(spark, sf):
    return scorers.soft_vote(wide_scores(spark, sf), MODELS).select("case", "prob_ensemble")


@query("predict_class")
def _(spark, sf):
    rows = scores(spark, sf)
    return rows.select(
        "case",
        "model",
        scorers.predict_class(F.col("prob")).alias("above"),
        scorers.predict_class(F.col("prob"), 0.5, inclusive=True).alias("at_or_above"),
    )


def _classed(spark, sf):
    return scores(spark, sf).withColumn("predicted", scorers.predict_class(F.col("prob")))


@query("binary_metrics")
def _(spark, sf):
    return metrics.binary_metrics(_classed(spark, sf), ["model"])


@query("roc_auc")
def _(spark, sf):
    return metrics.roc_auc(scores(spark, sf), ["model"])


@query("evaluate_models")
def _(spark, sf):
    return metrics.evaluate_models(scores(spark, sf))


@query("sensitivity_specificity")
def _(spark, sf):
    return metrics.sensitivity_specificity(_classed(spark, sf), ["model"])


@query("ensemble_metrics")
def _(spark, sf):
    rows = wide_scores(spark, sf)
    parts = {m: rows.select("case", F.col(f"prob_{m}").alias("prob")) for m in MODELS}
    return metrics.ensemble_metrics(parts, rows.select("case", "label"))


@query("cv_scores")
def _(spark, sf):
    rows = stored(spark, scaled(spark, sf), "training")
    return training.cv_scores(training.logistic_out_of_fold(rows, ORDER_FEATURES, "case"))


@query("roc_pr_curves")
def _(spark, sf):
    """Of logistic models refitted for each of five consecutive folds: the ROC points and their grid
    mean, the precision-recall points, and the confusion counts over folds that keep the classes' shares
    (x is 2 * label + predicted class)."""
    rows = stored(spark, scaled(spark, sf), "training")
    held = stored(spark, training.logistic_out_of_fold(rows, ORDER_FEATURES, "case", stratify=None), "held-out")
    points = stored(spark, metrics.curve_points(held, ["fold"]), "curve-points")
    confusion = metrics.out_of_fold_confusion(training.logistic_out_of_fold(rows, ORDER_FEATURES, "case"))
    cells = F.array(
        *[F.struct(F.lit(float(x)).alias("x"), F.col(c).cast("double").alias("y")) for x, c in enumerate(("tn", "fp", "fn", "tp"))]
    )
    roc = F.struct(F.lit("roc").alias("curve"), F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    pr = F.struct(F.lit("pr").alias("curve"), F.col("recall").alias("x"), F.col("precision").alias("y"))
    grid = metrics.mean_roc(points).select(
        F.lit("mean_roc").alias("curve"), F.col("fpr").alias("x"), F.col("mean_tpr").alias("y")
    )
    counts = confusion.select(F.inline(cells)).select(F.lit("confusion").alias("curve"), "x", "y")
    return grid.unionByName(points.select(F.inline(F.array(roc, pr)))).unionByName(counts)


@query("mean_abs_attribution")
def _(spark, sf):
    rows = scaled(spark, sf)
    means = {f: s.mean for f, s in scaling.column_stats(rows, ORDER_FEATURES).items()}
    phi = attribution.linear_attribution(rows, data.LINEAR_WEIGHTS, means, ["case", "label"])
    return attribution.mean_abs_attribution(phi)


@query("coalition_attribution")
def _(spark, sf):
    """Exact Shapley values of the model with steps against the mean row, which is 0 in scaled units."""
    rows = scaled(spark, sf)
    base = {f: 0.0 for f in SCALED_FEATURES} | {"returned": scaling.column_stats(rows, ["returned"])["returned"].mean}
    phi = attribution.coalition_attribution(rows, SCORERS["rf"], ORDER_FEATURES, base, ["case", "label"])
    return attribution.mean_abs_attribution(phi)


@query("permutation_attribution")
def _(spark, sf):
    rows = scaled(spark, sf)
    means = {f: s.mean for f, s in scaling.column_stats(rows, ORDER_FEATURES).items()}
    phi = attribution.permutation_attribution(
        rows, SCORERS["rf"], ORDER_FEATURES, means, ["case", "label"], permutations=8
    )
    return attribution.mean_abs_attribution(phi)


@query("fitted_consensus")
def _(spark, sf):
    """A feature CSV, split, standardized and learned by three models, whose areas under the curve weigh
    their votes on the validation cases."""
    path = new_table_path(spark, "features-csv")
    delimited.write_feature_csv(data.order_features(spark, sf).select("case", *ORDER_FEATURES, "label"), path)
    rows = delimited.read_feature_csv(spark, path, CSV_SCHEMA).withColumn("timepoint", F.lit(0))
    fits = {
        "even": lambda part: training.train_logistic(part, ORDER_FEATURES, balanced=True),
        "lr": lambda part: training.train_logistic(part, ORDER_FEATURES),
        "svm": lambda part: training.train_svm_calibrated(part, ORDER_FEATURES),
    }
    found = fitted.fitted_panel(rows, ORDER_FEATURES, SCALED_FEATURES, fits)
    return found.select(
        *KEYS, "label", "winner", "score", "consensus", joined_names("models").alias("models"),
        "avg_percent_consensus", "avg_percent_all",
    )


# --- effect coefficients ----------------------------------------------------------------------
@query("base2_logit")
def _(spark, sf):
    return scores(spark, sf).select("case", "model", base2_logit(F.col("prob")).alias("logit"))


@query("perturbation_plan")
def _(spark, sf):
    return fx.plan_table(data.order_features(spark, sf), ORDER_FEATURES)


@query("static_effects")
def _(spark, sf):
    return fx.effects_long(raw_effects(spark, sf))


@query("series_effects")
def _(spark, sf):
    rows = filled_days(spark, sf)
    plan = [fx.Perturbation(f) for f in DAY_FEATURES]
    length = values.series_length(rows)
    return fx.effects_long(fx.series_effects(rows, plan, data.SERIES_SCORERS, length))


@query("effects_wide")
def _(spark, sf):
    return fx.effects_wide(raw_effects(spark, sf), MODELS, ORDER_FEATURES)


@query("normalize_effects")
def _(spark, sf):
    return fx.effects_long(norm_effects(spark, sf))


@query("join_model_effects")
def _(spark, sf):
    rows = scaled(spark, sf)
    parts = [
        fx.normalize_effects(fx.static_effects(rows, PLAN, {m: SCORERS[m]})) for m in MODELS
    ]
    joined = fx.join_model_effects(
        *parts,
        features=["qty", "price", "returned"],
        data=rows.select(*KEYS, *ORDER_FEATURES),
        labels=rows.select(*KEYS, "label"),
    )
    return fx.effects_wide(joined, MODELS, ["qty", "price", "returned"])


@query("perturbation_sweep")
def _(spark, sf):
    return fx.perturbation_sweep(scaled(spark, sf), PLAN, SCORERS, [*SWEEP, 0.3, 0.1, 0.01])


# --- ranks, overlap, consensus, reports -------------------------------------------------------
@query("rank_effects")
def _(spark, sf):
    return ranking.ranks_wide(ranked(spark, sf, rank=3), MODELS, 3)


@query("rank_frequency")
def _(spark, sf):
    return ranking.rank_frequency(ranking.ranks_long(ranked(spark, sf, rank=3)))


@query("winner_frequency")
def _(spark, sf):
    return ranking.winner_frequency(votes.consensus_rows(voted(spark, sf)), "CON@5")


def _pair_lists(spark, sf, rank=5):
    """Every row's ranked lists of two models side by side."""
    rows = ranked(spark, sf, rank)
    lists = rows.select(
        *KEYS, *[ranking.ranked_features(m).alias(f"__l{i}") for i, m in enumerate(MODELS)]
    )
    pairs = [(1, 0), (2, 0), (2, 1)]
    packed = F.array(
        *[
            F.struct(
                F.lit(MODELS[a]).alias("model_a"),
                F.lit(MODELS[b]).alias("model_b"),
                F.col(f"__l{a}").alias("s"),
                F.col(f"__l{b}").alias("t"),
            )
            for a, b in pairs
        ]
    )
    return lists.select(*KEYS, F.inline_outer(packed))


@query("rank_biased_overlap")
def _(spark, sf):
    s, t = F.col("s"), F.col("t")
    return _pair_lists(spark, sf).select(
        *KEYS,
        "model_a",
        "model_b",
        rank_biased_overlap(s, t, p=0.9).alias("rbo"),
        rank_biased_overlap(s, t, p=0.9, k=2).alias("rbo_at_2"),
    )


@query("average_overlap")
def _(spark, sf):
    return _pair_lists(spark, sf).select(
        *KEYS, "model_a", "model_b", average_overlap(F.col("s"), F.col("t")).alias("ao")
    )


@query("rbo_extrapolated")
def _(spark, sf):
    return _pair_lists(spark, sf).select(
        *KEYS,
        "model_a",
        "model_b",
        rank_biased_overlap(F.col("s"), F.col("t"), p=0.9, ext=True).alias("rbo_ext"),
    )


@query("rbo_uneven")
def _(spark, sf):
    return _pair_lists(spark, sf).select(
        *KEYS,
        "model_a",
        "model_b",
        rank_biased_overlap_uneven(F.col("s"), F.col("t"), p=0.98).alias("rbo_uneven"),
    )


@query("top_weight")
def _(spark, sf):
    ps = F.explode(F.array(F.lit(0.5), F.lit(0.9), F.lit(0.98)))
    rows = _pair_lists(spark, sf).withColumn("p", ps)
    depth = F.least(F.size("s"), F.size("t"))
    return rows.select(*KEYS, "model_a", "model_b", "p", top_weight(F.col("p"), depth).alias("top_weight"))


@query("pairwise_model_rbo")
def _(spark, sf):
    wide = ranking.pairwise_model_rbo(with_overlaps(spark, sf), MODELS)
    return wide.withColumns({f"{m}_ranked": joined_names(f"{m}_ranked") for m in MODELS})


@query("rbo_summary")
def _(spark, sf):
    return ranking.rbo_summary(ranked(spark, sf), MODELS, 5)


@query("consensus_winner")
def _(spark, sf):
    parts = []
    for policy in ("sum", "mean"):
        rows = votes.consensus_rows(voted(spark, sf, weights=WEIGHTS, policy=policy))
        parts.append(
            rows.select(
                *KEYS, "winner", "score", "consensus", joined_names("models").alias("models")
            ).withColumn("policy", F.lit(policy))
        )
    return parts[0].unionByName(parts[1])


@query("consensus_risk_reduction")
def _(spark, sf):
    return votes.consensus_rows(voted(spark, sf)).select(
        *KEYS, "winner", "avg_percent_consensus", "avg_percent_all"
    )


@query("consensus_with_overlap")
def _(spark, sf):
    rows = votes.with_consensus(with_overlaps(spark, sf), ORDER_FEATURES)
    return votes.consensus_with_overlap(rows)


@query("case_effect_stats")
def _(spark, sf):
    return reports.case_effect_stats(norm_effects(spark, sf))


@query("threshold_count")
def _(spark, sf):
    rows = norm_effects(spark, sf)
    risk = votes.ensemble_risk()
    return rows.select(
        *KEYS,
        votes.threshold_count(risk, MODELS).alias("n_above"),
        votes.threshold_count(risk, MODELS, ["qty", "disc"], 0.45, "below").alias("n_below"),
    )


@query("best_feature")
def _(spark, sf):
    return votes.best_feature(norm_effects(spark, sf), ORDER_FEATURES).drop("panel")


@query("most_abnormal")
def _(spark, sf):
    return scaled(spark, sf).select(
        *KEYS, votes.most_abnormal(ORDER_FEATURES).alias("most_abnormal")
    )


@query("model_panel")
def _(spark, sf):
    return panel.panel_report(
        scaled(spark, sf), PLAN, SCORERS, label="label"
    ).withColumn("models", joined_names("models"))


@query("top_features_by_risk")
def _(spark, sf):
    return reports.top_features_by_risk(norm_effects(spark, sf), ORDER_FEATURES, 3)


@query("panel_table")
def _(spark, sf):
    return reports.panel_table(norm_effects(spark, sf).drop("label"), MODELS, ORDER_FEATURES)


@query("rank_heatmap")
def _(spark, sf):
    rows = ranking.rank_effects(day_effects(spark, sf), 1)
    return reports.rank_heatmap(ranking.ranks_long(rows), "mlp", 10)


def _day_votes(spark, sf):
    rows = ranking.rank_effects(day_effects(spark, sf), 3)
    return votes.consensus_rows(votes.with_consensus(rows, DAY_FEATURES))


@query("consensus_heatmap")
def _(spark, sf):
    return reports.consensus_heatmap(_day_votes(spark, sf), 10)


@query("policy_table")
def _(spark, sf):
    top = ranking.ranks_long(ranked(spark, sf, rank=1))
    winners = {
        "con1": votes.consensus_rows(voted(spark, sf, rank=1)),
        "con3": votes.consensus_rows(voted(spark, sf, rank=3)),
    }
    return reports.policy_table(top, winners, MODELS, ORDER_FEATURES)


def _votes_with_rbo(spark, sf, models, baselines=None):
    """Votes of a panel of models with the mean overlap of the row."""
    rows = fx.static_effects(
        scaled(spark, sf), PLAN, {m: SCORERS[m] for m in models}, baselines, carry=["label"]
    )
    rows = ranking.rank_effects(fx.normalize_effects(rows), len(PLAN))
    rows = ranking.with_rbos(rows, models, len(PLAN))
    rows = votes.with_consensus(rows, ORDER_FEATURES).withColumn("rbo", ranking.mean_rbo())
    return votes.consensus_rows(rows)


@query("panel_overlap_comparison")
def _(spark, sf):
    return reports.panel_overlap_comparison(
        {
            "two": _votes_with_rbo(spark, sf, ["lr", "mlp"]),
            "three": _votes_with_rbo(spark, sf, MODELS),
        }
    )


@query("sensitivity_counts")
def _(spark, sf):
    rows = _votes_with_rbo(spark, sf, MODELS, [None, 0.5, 0.3, 0.1])
    return reports.sensitivity_counts(rows, SCALED_FEATURES, top_k=3)


@query("importance_comparison")
def _(spark, sf):
    rows = scaled(spark, sf)
    means = {f: s.mean for f, s in scaling.column_stats(rows, ORDER_FEATURES).items()}
    phi = attribution.linear_attribution(rows, data.LINEAR_WEIGHTS, means, ["case", "label"])
    return reports.importance_comparison(
        votes.consensus_rows(voted(spark, sf)), attribution.mean_abs_attribution(phi)
    )


@query("case_timeline")
def _(spark, sf):
    rows = day_effects(spark, sf).withColumn("orig_prob_ensemble", votes.ensemble_risk())
    rows = votes.best_feature(rows, DAY_FEATURES)
    return reports.case_timeline(rows, data.user_days(spark, sf), DAY_FEATURES)
