import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tiltframe.operators.split import split_by_case
from tiltframe.operators import attribution, folded, forests, metrics, networks, profiling, scaling, training
from tiltframe.operators.folded import LinearLogistic
from tiltframe.operators.scorers import BatchScorer, ColumnScorer, MLScorer, Trees, bin_number, score_long, soft_vote
from tiltframe.plans.panel import weights_from_metrics
from tiltframe.sources import delimited, tables

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(400):
        y = int(rng.random() < 0.3)
        data.append((i, rng.gauss(2.0 * y, 1), rng.gauss(-y, 1), y))
    return spark.createDataFrame(data, '`case` bigint, a double, b double, label int').repartition(2).cache()


def auc_of(scorer, rows):
    return metrics.roc_auc(score_long(rows, FEATURES, {"m": scorer}, ["case", "label"]), ["model"]).first()["roc_auc"]


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_minimizes_the_stated_loss(rows, balanced):
    scorer = training.train_logistic(rows, FEATURES, c=0.05, balanced=balanced)
    w, b = np.array(scorer.model.coefficients), scorer.model.intercept
    pdf = rows.toPandas()
    x, y = pdf[FEATURES].to_numpy(), pdf["label"].to_numpy()
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) if balanced else 1.0
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = w + 0.05 * ((weight * (p - y)) @ x)
    assert np.abs(gradient).max() < 1e-3 and abs((weight * (p - y)).sum()) < 1e-2


def test_trained_models_separate_the_classes(rows):
    fits = {
        "forest": training.train_forest_calibrated(rows, FEATURES, trees=10, depth=4, folds=2),
        "svm": training.train_svm_calibrated(rows, FEATURES, folds=2),
        "mlp": training.train_mlp(rows, FEATURES, balanced=True, iterations=15),
        "gbt": training.train_boosted_trees(rows, FEATURES, rounds=5, depth=3),
    }
    scores = score_long(rows, FEATURES, fits, ["case", "label"]).cache()
    low, high = scores.agg(F.min("prob"), F.max("prob")).first()
    assert 0.0 <= low and high <= 1.0 and scores.count() == 1600
    aucs = {r["model"]: r["roc_auc"] for r in metrics.roc_auc(scores, ["model"]).collect()}
    assert all(v > 0.9 for v in aucs.values()), aucs


def test_forests_keep_the_nodes_of_rows_between_levels(rows):
    """Without it each level of a forest walks all trees from their roots; the forest is the same."""
    calibrated = training.train_forest_calibrated(rows, FEATURES, trees=10, depth=4, folds=2)
    kept = calibrated.members[0][0].model
    assert kept.getCacheNodeIds()
    plain = RandomForestClassifier(featuresCol="v", numTrees=10, maxDepth=4, seed=7)
    part = training._with_folds(rows, "case", 2, 7).where("__fold != 0")
    part = part.withColumn("v", array_to_vector(F.array("a", "b")))
    assert kept.toDebugString.split("\n")[1:] == plain.fit(part).toDebugString.split("\n")[1:]


def test_boosted_trees_learn_from_counted_cells(spark):
    """3,000 rows in at most 2 * 2 * 7 * 5 cells give the trees that the rows give."""
    n = F.col("id")
    rows = spark.range(3000, numPartitions=3).select(
        n.alias("case"),
        (n * 7 % 13 % 7 - 2).cast("double").alias("a"),
        (n * n % 11 % 5 / 4).alias("b"),
        (n % 2).cast("double").alias("c"),
        ((n * 7 % 13 % 7 + n * n % 11 % 5 + n * 31 % 17 % 4) > 6).cast("int").alias("label"),
    )
    features = ["a", "b", "c"]
    edges = training._bin_edges(rows, features)
    assert edges["a"] == [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0] and edges["c"] == [1.0]
    cells = training._cells(rows, features, edges)
    assert cells.count() <= 140 and cells.agg(F.sum("__rows")).first()[0] == 3000
    fits = {
        "rows": training.train_boosted_trees(rows, features, rounds=6, depth=3),
        "cells": training.train_boosted_trees(rows, features, rounds=6, depth=3, cells_from=1),
    }
    both = score_long(rows, features, fits, ["case", "label"]).groupBy("case").pivot("model", ["rows", "cells"])
    both = both.agg(F.first("prob"))
    assert both.agg(F.max(F.abs(F.col("rows") - F.col("cells")))).first()[0] < 1e-9
    assert both.agg(F.stddev("rows")).first()[0] > 0.1


def test_bins_of_many_values(spark):
    rows = spark.range(10000).select((F.col("id") / 100).alias("x"), F.lit(None).cast("double").alias("n"))
    edges = training._bin_edges(rows, ["x"])["x"]
    assert len(edges) == training.BINS - 1 and edges == sorted(edges)
    got = rows.select(bin_number(F.col("x"), edges).alias("k"), bin_number(F.col("n"), edges).alias("n"), "x").collect()
    assert all(r["k"] == sum(e <= r["x"] for e in edges) and r["n"] is None for r in got)
    counts = [sum(r["k"] == k for r in got) for k in range(training.BINS)]
    assert min(counts) > 250 and max(counts) < 400


def test_oversampling_balances(rows):
    counts = {r["label"]: r["count"] for r in training.oversample(rows).groupBy("label").count().collect()}
    assert abs(counts[0] - counts[1]) < 0.1 * counts[0]


def test_auc_equals_the_evaluator_with_ties(spark):
    rng = random.Random(8)
    data = [(rng.randint(0, 1), rng.choice([0.1, 0.25, 0.25000001, 0.5, 0.9])) for _ in range(500)]
    df = spark.createDataFrame(data, "label int, prob double")
    expected = BinaryClassificationEvaluator(rawPredictionCol="prob", numBins=0).evaluate(df)
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(expected)
    assert metrics.roc_auc(df.where("label = 1")).first()["roc_auc"] is None


def test_undefined_rates_are_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, predicted int")
    got = metrics.binary_metrics(df).first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"]) == (0.5, 0.0, 0.0, 0.0)


def test_ensemble_needs_the_same_cases(spark, rows):
    a = rows.select("case", (F.col("case") % 10 / 10).alias("prob"))
    labels = rows.select("case", "label")
    one = metrics.ensemble_metrics({"x": a, "y": a}, labels).first()
    assert one["tp"] + one["fp"] + one["tn"] + one["fn"] == 400
    with pytest.raises(Exception, match="different cases"):
        metrics.ensemble_metrics({"x": a, "y": a.where("case > 0")}, labels).collect()


def test_consecutive_folds(spark):
    df = spark.range(23).select(F.col("id").alias("case"), (F.col("id") % 2).cast("int").alias("label"))
    plain = [r["fold"] for r in metrics.contiguous_folds(df, "case", 5).orderBy("case").collect()]
    assert plain == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
    strat = metrics.contiguous_folds(df, "case", 5, "label").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in strat} == {2, 3} and len(strat) == 10


def test_mean_roc_equals_interpolation(spark):
    rng = random.Random(12)
    data = [(f, rng.randint(0, 1), rng.choice([0.1, 0.2, 0.3, 0.55, 0.6, 0.8])) for f in range(3) for _ in range(60)]
    df = spark.createDataFrame(data, "fold int, label int, prob double")
    got = {round(r["fpr"] * 99): r["mean_tpr"] for r in metrics.mean_roc(metrics.curve_points(df, ["fold"])).collect()}
    grid, curves = np.linspace(0, 1, 100), []
    for f in range(3):
        part = [(y, p) for g, y, p in data if g == f]
        pos, neg = sum(y for y, _ in part), sum(1 - y for y, _ in part)
        fpr, tpr = [0.0], [0.0]
        for s in sorted({p for _, p in part}, reverse=True):
            fpr.append(sum(1 - y for y, p in part if p >= s) / neg)
            tpr.append(sum(y for y, p in part if p >= s) / pos)
        curves.append(np.interp(grid, fpr, tpr))
    assert [got[i] for i in range(100)] == pytest.approx(list(np.mean(curves, axis=0)))


def test_cross_validation_table(rows):
    held = training.out_of_fold_scores(rows, FEATURES, lambda p: training.train_logistic(p, FEATURES), "case", folds=3)
    table = {r["fold"]: r for r in training.cv_scores(held).collect()}
    assert set(table) == {"0", "1", "2", "mean", "std"}
    folds = [table[str(i)]["roc_auc"] for i in range(3)]
    assert table["mean"]["roc_auc"] == pytest.approx(np.mean(folds))
    assert table["std"]["roc_auc"] == pytest.approx(np.std(folds, ddof=1))
    assert metrics.out_of_fold_confusion(held).first()["tp"] > 0


def test_attributions_add_up(rows):
    linear = ColumnScorer(lambda v: 0.2 + 0.1 * v["a"] * v["b"])
    base = {"a": 0.5, "b": -1.0}
    phi = attribution.permutation_attribution(rows, linear, FEATURES, base, ["case", "a", "b"], permutations=6)
    for r in phi.limit(50).collect():
        total = sum(x["attribution"] for x in r["attributions"])
        assert total == pytest.approx(0.1 * r["a"] * r["b"] + 0.05)
    exact = attribution.linear_attribution(rows, {"a": 2.0}, {"a": 0.5}, ["case", "a", "label"])
    assert all(r["attributions"][0]["attribution"] == pytest.approx(2 * (r["a"] - 0.5)) for r in exact.take(5))
    assert attribution.mean_abs_attribution(exact).count() == 2


def test_imputation_scaling_and_weights(spark):
    df = spark.createDataFrame([(0.0, 1, None), (2.0, 0, 4.0), (4.0, 0, 8.0)], "x double, Outcome int, y double")
    filled = scaling.impute(df, ["y"]).collect()
    assert [r["y"] for r in filled] == [6.0, 4.0, 8.0]
    assert [r["x"] for r in scaling.impute_zero_as_missing(df, ["x", "Outcome"]).collect()] == [3.0, 2.0, 4.0]
    fit = scaling.Scaler.fit(df, ["x"])
    scaled = fit.transform(df)
    assert scaled.agg(F.avg("x"), F.stddev_pop("x")).first()[:] == (pytest.approx(0.0), pytest.approx(1.0))
    assert [r["x"] for r in fit.inverse(scaled).collect()] == [0.0, 2.0, 4.0]
    assert scaling.Scaler.fit(df.withColumn("k", F.lit(3.0)), ["k"]).stats["k"].std == 1.0
    weights = {r["Outcome"]: r["weight"] for r in scaling.class_weights(df, "Outcome").collect()}
    assert weights == {1: 1.5, 0: 0.75}
    found = {r["feature"]: (r["is_binary"], r["is_zero_one"]) for r in scaling.binary_columns(df, ["x", "Outcome", "y"]).collect()}
    assert found == {"x": (0, 0), "Outcome": (1, 1), "y": (1, 0)}


def test_histogram_equals_numpy(spark, rows):
    values = np.array([r["a"] for r in rows.select("a").collect()])
    counts, edges = np.histogram(values, 30)
    density, _ = np.histogram(values, 30, density=True)
    got = profiling.histogram_density(rows, ["a"]).orderBy("bin").collect()
    assert [r["count"] for r in got] == list(counts)
    assert [r["density"] for r in got] == pytest.approx(list(density))
    assert [r["bin_start"] for r in got] == pytest.approx(list(edges[:-1]))


def test_demo_csv_with_windows_line_ends(spark, tmp_path):
    header = "Pregnancies,Glucose,BloodPressure,SkinThickness,Insulin,BMI,DiabetesPedigreeFunction,Age,Outcome"
    path = tmp_path / "demo.csv"
    path.write_bytes((header + "\r\n3,131,70,35,0,29.5,0.44,52,1\r\n2,97,61,0,0,24.25,0.3,33,0\r\n").encode())
    df = delimited.read_feature_csv(spark, str(path))
    assert df.orderBy("Age").first()["Outcome"] == 0
    columns = df.columns
    fixed = scaling.impute_zero_as_missing(df, columns).orderBy("Age").collect()
    assert fixed[0]["SkinThickness"] == 35.0 and fixed[0]["Insulin"] is None and fixed[0]["Outcome"] == 0
    bad = tmp_path / "bad.csv"
    bad.write_text("x,y\n1,2\n")
    with pytest.raises(Exception, match="CSV header"):
        delimited.read_feature_csv(spark, str(bad)).collect()


def test_tables_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5), path)
    assert tables.replace_table(spark.range(3), path).count() == 3
    assert tables.read_study_table(spark, path).count() == 3


def test_vote_weights_from_metrics(rows):
    scorers = {"p": ColumnScorer(lambda v: 1.0 / (1.0 + F.exp(-v["a"]))), "q": ColumnScorer(lambda v: 1.0 / (1.0 + F.exp(v["b"])))}
    table = metrics.evaluate_models(score_long(rows, FEATURES, scorers, ["case", "label"]))
    weights = weights_from_metrics(table, "roc_auc")
    assert set(weights) == {"p", "q"} and all(0.5 < w < 1 for w in weights.values())
    wide = rows.withColumns({"prob_p": F.lit(0.2), "prob_q": F.lit(0.6)})
    assert soft_vote(wide, ["p", "q"]).first()["prob_ensemble"] == pytest.approx(0.4)


def test_null_scores_and_null_cases_are_named(spark):
    df = spark.createDataFrame([(1, 0.9), (1, None), (0, 0.3), (0, 0.95)], "label int, prob double")
    with pytest.raises(Exception, match="prob is null"):
        metrics.roc_auc(df).collect()
    cases = spark.createDataFrame([(1,), (None,)], "case long")
    with pytest.raises(ValueError, match="case is null"):
        split_by_case(cases)


def test_scores_of_a_rare_event_are_spread_over_chunks(spark):
    df = spark.range(3000).selectExpr("int(id % 7 = 0) AS label", "(id * id % 3001 + 1) / 4e9D AS prob")
    rows = df.collect()
    pos, neg = [r.prob for r in rows if r.label], [r.prob for r in rows if not r.label]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(wins / len(pos) / len(neg))
    odds = F.log(F.col("prob") / (1 - F.col("prob")))
    assert df.select(F.floor(odds * metrics.CHUNKS_PER_LOGIT)).distinct().count() > 500


@pytest.mark.parametrize("balanced", [False, True])
def test_folds_fitted_together_equal_separate_fits(rows, balanced):
    data = metrics.contiguous_folds(rows, "case", 4).cache()
    together = folded.fit_folds(data, FEATURES, "fold", 4, c=0.3, balanced=balanced)
    assert np.abs(folded.residuals(data, FEATURES, "fold", together, 0.3, balanced)).max() < 1e-7
    for i in range(5):
        alone = training.train_logistic(data.where(F.col("fold") != i), FEATURES, 0.3, balanced)
        assert together[i] == pytest.approx(alone.weights[0], abs=1e-9)
    held = {r["case"]: r["prob"] for r in folded.folded_scores(data, FEATURES, folds=4, c=0.3, balanced=balanced).collect()}
    for r in data.collect():
        margin = together[r["fold"]] @ [r["a"], r["b"], 1]
        assert held[r["case"]] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_folds_that_cannot_be_learned(spark, rows):
    data = metrics.contiguous_folds(rows, "case", 4)
    with pytest.raises(ValueError, match="outside of fold 0 are all of one class"):
        folded.fit_folds(data.where("label = 1 OR fold = 0"), FEATURES, "fold", 4)
    with pytest.raises(ValueError, match="label is 2"):
        folded.fit_folds(data.withColumn("label", F.lit(2)), FEATURES, "fold", 4)
    with pytest.raises(ValueError, match="not finite"):
        folded.fit_folds(data.withColumn("a", F.when(F.col("case") > 3, F.col("a"))), FEATURES, "fold", 4)


def test_separable_classes_stay_finite(spark):
    df = spark.createDataFrame([(i, float(i), int(i >= 20)) for i in range(40)], "`case` long, a double, label int")
    weights = training.train_logistic(df, ["a"], c=100.0).weights[0]
    assert np.isfinite(weights).all() and weights[0] > 0.5


def test_exact_coalitions(rows):
    """Efficiency, symmetry, null players, and the mean over all orders."""
    features = ["a", "b", "c", "d"]
    data = rows.withColumns({"c": F.col("a") + F.col("b"), "d": F.lit(3.0)}).limit(40)
    scorer = ColumnScorer(lambda v: 0.1 * v["a"] * v["b"] + F.when(v["c"] > 0.5, v["a"]).otherwise(v["b"]) + 0.2 * v["c"])
    base = {"a": 0.5, "b": -1.0, "c": 0.3, "d": 1.0}
    exact = attribution.coalition_attribution(data, scorer, features, base, ["case", "a", "b", "c"]).collect()

    def score(v):
        return 0.1 * v["a"] * v["b"] + (v["a"] if v["c"] > 0.5 else v["b"]) + 0.2 * v["c"]

    for r in exact:
        got = {x["feature"]: x["attribution"] for x in r["attributions"]}
        row, want = {"a": r["a"], "b": r["b"], "c": r["c"], "d": 3.0}, dict.fromkeys(features, 0.0)
        for order in permutations(features):
            at = dict(base)
            for f in order:
                before = score(at)
                at[f] = row[f]
                want[f] += (score(at) - before) / 24
        assert got == pytest.approx(want) and got["d"] == 0
        assert sum(got.values()) == pytest.approx(score(row) - score(base))
    alike = ColumnScorer(lambda v: v["a"] * v["b"])
    same = data.withColumn("b", F.col("a"))
    for r in attribution.coalition_attribution(same, alike, ["a", "b"], {"a": 1.0, "b": 1.0}, ["case"]).collect():
        assert r["attributions"][0]["attribution"] == pytest.approx(r["attributions"][1]["attribution"])
    with pytest.raises(ValueError, match="sample orders"):
        attribution.coalition_attribution(data, scorer, [f"f{i}" for i in range(13)], {}, [])


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64)) @ rng.standard_normal((64, 64)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 5.0
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, [f"c{i}" for i in range(64)]).repartition(3)
    got = profiling.correlations(df, df.columns)
    for i, j in ((0, 1), (5, 60), (33, 34), (63, 2), (12, 12)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert np.isnan(got[7]).all()
    top = profiling.top_abs_correlations(df, df.columns, 3).collect()
    upper = np.nan_to_num(np.abs(got[np.triu_indices(64, 1)]))
    assert [r["corr"] for r in top] == pytest.approx(sorted(upper, reverse=True)[:3])
    assert profiling.top_abs_correlations(df.limit(0), df.columns).collect() == []


def test_squared_hinge_and_sigmoids_are_at_their_least(rows):
    data = metrics.contiguous_folds(rows, "case", 3).cache()
    weights = folded.fit_folds(data, FEATURES, "fold", 3, c=0.5, loss="squared_hinge")
    pdf = data.toPandas()
    x, y, fold = np.column_stack((pdf[FEATURES], np.ones(len(pdf)))), pdf["label"].to_numpy(), pdf["fold"].to_numpy()
    sign = 2 * y - 1
    for i in range(4):
        use = fold != i
        short = np.maximum(0, 1 - sign * (x @ weights[i])) * use
        gradient = -2 * (sign * short) @ x + np.append(weights[i][:2] / 0.5, 0)
        assert np.abs(gradient).max() < 1e-7
    raw = LinearLogistic(weights[:3], FEATURES, "fold").margin({f: F.col(f) for f in FEATURES})
    sigmoids = folded.fit_sigmoids(data.withColumn("raw", raw), "raw", "fold", 3)
    for i in range(3):
        own, label = x[fold == i] @ weights[i], y[fold == i]
        n1, n0 = label.sum(), (1 - label).sum()
        target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        error = 1 / (1 + np.exp(-(sigmoids[i][0] * own + sigmoids[i][1]))) - target
        assert abs(error.sum()) < 1e-7 and abs(error @ own) < 1e-6


def test_trees_equal_the_fitted_models(spark, rows, tmp_path):
    """Every variant of a row in one call, as the model's own transform scores them."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    data = training._assembled(rows, FEATURES)
    names = {"featuresCol": training.VECTOR, "labelCol": "label", "seed": 3}
    models = {
        "forest": RandomForestClassifier(numTrees=7, maxDepth=6, **names).fit(data),
        "boosted": GBTClassifier(maxIter=6, maxDepth=3, **names).fit(data),
    }
    a, b = F.col("a"), F.col("b")
    variants = {"v0": {"a": a, "b": b}, "v1": {"a": F.lit(0.0), "b": b}, "v2": {"a": a, "b": -b}, "v3": {"a": b, "b": a}}
    for name, model in models.items():
        trees = Trees.of(model, f"{tmp_path}/{name}")
        walked = BatchScorer(trees, FEATURES).add_scores(rows, variants)
        plan = walked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        own = MLScorer(model, FEATURES).add_scores(rows, variants)
        for x, y in zip(walked.orderBy("case").collect(), own.orderBy("case").collect(), strict=True):
            assert [x[v] for v in variants] == pytest.approx([y[v] for v in variants])


def _many_features(spark, n=3000, width=10, pieces=3):
    """Label from a few of ``width`` features with few and with many values."""
    i = F.col("case")
    values = [(F.hash(i, F.lit(j)) % (7 if j % 2 else 1000) / 7.0).alias(f"x{j}") for j in range(width)]
    noise = F.abs(F.hash(i, F.lit("noise"))) % 10 < 2
    called = ((F.col("x0") > 10) | (F.col("x1") > 0.2)) != noise
    rows = spark.range(n, numPartitions=pieces).withColumnRenamed("id", "case").select("case", *values)
    return rows.withColumn("label", called.cast("int")), [f"x{j}" for j in range(width)]


def _place_by_steps(trees, tree, cells):
    """The node of a row, walked split by split."""
    place = 0
    for level in range(trees.level):
        node = (1 << level) - 1 + place
        place = 2 * place + int(cells[trees.feature[tree, node]] > trees.cut[tree, node])
    return place


@pytest.mark.parametrize(("width", "depth"), [(3, 7), (10, 3)])
def test_forests_grown_together_split_at_their_best(spark, width, depth):
    """Counted again row by row: every node's rows by its draws, and no better split by its features."""
    rows, features = _many_features(spark, width=width)
    data = training._with_folds(rows, "case", 3, 7).withColumn("key", F.xxhash64("case"))
    edges = training._bin_edges(rows, features)
    fit = lambda df: forests.fit_forests(df, features, "label", "__fold", "key", edges, 3, 4, depth, 7)
    grown = fit(data)
    pdf = data.orderBy("case").toPandas()
    cells = forests.binned(pdf[features].to_numpy().T, [np.array(edges[f]) for f in features])
    halves = pdf["key"].to_numpy().view(np.uint32)
    k = math.ceil(math.sqrt(width))
    for fold, tree in ((0, 0), (2, 3)):
        trees, values = grown[fold].trees, grown[fold].values[tree]
        often = forests.draws(halves[::2].copy(), halves[1::2].copy(), 7, tree) * (pdf["__fold"] != fold).to_numpy()
        assert abs(often.sum() - (pdf["__fold"] != fold).sum()) < 200
        last = np.array([_place_by_steps(trees, tree, c) for c in cells.T])
        label, splits = pdf["label"].to_numpy(), 0
        for level in range(depth):
            chosen = forests._chosen(7, tree, fold, level, width, k)
            for p in range(1 << level):
                node, here = (1 << level) - 1 + p, last >> (depth - level) == p
                if trees.cut[tree, node] == forests.NO_CUT:
                    continue
                splits += 1
                def gini(at):
                    n, ones = often[at].sum(), often[at & (label == 1)].sum()
                    return 0.0 if n == 0 else n * 2 * (ones / n) * (1 - ones / n)
                left = {(f, c): here & (cells[f] <= c) for f in chosen[p] for c in range(len(edges[features[f]]))}
                cost = {at: gini(m) + gini(here & ~m) for at, m in left.items()}
                taken = (trees.feature[tree, node], trees.cut[tree, node])
                assert cost[taken] == pytest.approx(min(cost.values())) and cost[taken] < gini(here)
        assert splits > 2
        for place in np.unique(last):
            in_leaf = (last == place) & (often > 0)
            if in_leaf.any():
                assert values[place] == pytest.approx((often * label)[in_leaf].sum() / often[in_leaf].sum())
        one = forests.BinnedForest(forests.Trees(trees.feature[tree : tree + 1], trees.cut[tree : tree + 1], trees.bins, depth), values[None], grown[fold].edges)
        assert one(pdf[features]).tolist() == values[last].tolist()
    if width == 3:
        again = fit(data.repartition(7))
        assert all((a.values == b.values).all() and (a.trees.cut == b.trees.cut).all() for a, b in zip(grown, again, strict=True))


def test_forests_grown_together_learn_as_sparks(spark):
    """From many rows on no forest is grown by itself; the probabilities are as good and alike."""
    rows, features = _many_features(spark)
    fits = {
        name: training.train_forest_calibrated(rows, features, trees=20, depth=5, folds=2, together_from=least)
        for name, least in (("spark", 10**9), ("together", 1))
    }
    assert all(isinstance(m[0], BatchScorer) for m in fits["together"].members)
    scores = score_long(rows, features, fits, ["case", "label"]).cache()
    aucs = {r["model"]: r["roc_auc"] for r in metrics.roc_auc(scores, ["model"]).collect()}
    assert aucs["together"] > 0.8 and abs(aucs["together"] - aucs["spark"]) < 0.03
    both = scores.groupBy("case").pivot("model", ["spark", "together"]).agg(F.first("prob"))
    assert both.agg(F.corr("spark", "together")).first()[0] > 0.9


def test_forests_with_odd_rows_are_left_to_spark(spark, rows):
    assert training._plain_rows(rows, FEATURES) == 400
    assert training._plain_rows(rows.withColumn("a", F.when(F.col("case") > 0, F.col("a"))), FEATURES) == 0
    assert training._plain_rows(rows.withColumn("label", F.col("label") * 2), FEATURES) == 0
    constant = rows.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(2.0))
    fitted = training.train_forest_calibrated(constant, FEATURES, trees=3, depth=4, folds=2, together_from=1)
    probs = score_long(constant, FEATURES, {"m": fitted}, ["case"]).agg(F.min("prob"), F.max("prob")).first()
    assert probs[0] == probs[1] and 0.1 < probs[0] < 0.5


def test_network_gradient_and_loss_follow_the_definition(rows):
    rng = np.random.default_rng(5)
    sizes = [2, 4, 3, 2]
    weights = rng.normal(size=2 * 4 + 4 + 4 * 3 + 3 + 3 * 2 + 2)
    block = rows.select(*FEATURES, "label", (1 + F.col("case") % 3)).toPandas().to_numpy(float)
    got = networks.network_part(weights, sizes)(block)
    assert got[0] == block[:, -1].sum()
    (one, a), (two, b), (three, c) = networks._layers(weights, sizes)
    hidden = 1 / (1 + np.exp(-(1 / (1 + np.exp(-(block[:, :2] @ one.T + a))) @ two.T + b)))
    shares = np.exp(hidden @ three.T + c)
    shares /= shares.sum(1, keepdims=True)
    assert got[1] == pytest.approx(-(block[:, -1] * np.log(shares[np.arange(400), block[:, 2].astype(int)])).sum())
    for i in range(0, len(weights), 5):
        step = np.zeros(len(weights))
        step[i] = 1e-5
        up, down = (networks.network_part(weights + s, sizes)(block)[1] for s in (step, -step))
        assert got[2 + i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-5)


def test_networks_over_blocks_learn_as_sparks_from_the_same_start(rows):
    """From many rows on no row is copied: same start, a loss no worse, and the same model however rows lie."""
    fit = lambda df, least: training.train_mlp(
        df, FEATURES, seed=9, hidden=(6, 4), balanced=True, iterations=30, blocks_from=least
    )
    ours, spread, theirs = fit(rows, 1), fit(rows.repartition(7), 1), fit(rows, 10**9)
    copies = rows.select(*FEATURES, "label", training._copies(rows, "case", 9)).toPandas().to_numpy(float)
    assert copies[:, -1].sum() == training.oversample(rows, "case", 9).count()
    weights = [m.model.weights.toArray() for m in (ours, spread, theirs)]
    loss = [networks.network_part(w, [2, 6, 4, 2])(copies)[1] / copies[:, -1].sum() for w in weights]
    assert loss[0] == pytest.approx(loss[1], rel=1e-3) and loss[0] < loss[2] * 1.02
    probs = [score_long(rows, FEATURES, {"m": m}, ["case"]).toPandas().sort_values("case")["prob"].to_numpy() for m in (ours, theirs)]
    assert np.abs(probs[0] - probs[1]).mean() < 0.05
