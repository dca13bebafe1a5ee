import math
import random

import pandas as pd
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tiltframe.operators import consensus as votes
from tiltframe.operators import effects as fx
from tiltframe.operators import ranking, reports, values
from tiltframe.operators.scorers import BatchScorer, ColumnScorer, VoteScorer, predict_class, score_rows
from tiltframe.plans.panel import panel_frame
from tiltframe.plans.sweep import run_sweep
from tiltframe.sources.delimited import read_sweep_csv
from tiltframe.schemas import EFFECTS

FEATURES = ["a", "b", "c"]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def logit(p):
    return math.log2((p + 1e-16) / (1 - p + 1e-16))


def linear(v):
    return 1.0 / (1.0 + F.exp(-(0.3 + 0.8 * v["a"] - 0.5 * v["b"] + 0.4 * v["c"])))


def steep(v):
    return 1.0 / (1.0 + F.exp(-(0.1 * v["a"] + 1.5 * v["b"] - 0.2 * v["c"])))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, 0, rng.gauss(0, 1), rng.gauss(0, 1), float(i % 2), i % 2) for i in range(60)]
    return spark.createDataFrame(data, '`case` bigint, timepoint int, a double, b double, c double, label int')


@pytest.fixture(scope="module")
def plan(rows):
    return fx.perturbation_plan(rows, FEATURES)


def test_plan_finds_binary_features_and_rejects_the_rest(spark, rows, plan):
    assert [(s.feature, s.low, s.high) for s in plan] == [("a", None, None), ("b", None, None), ("c", 0.0, 1.0)]
    with pytest.raises(ValueError, match="k is constant"):
        fx.perturbation_plan(rows.withColumn("k", F.lit(1.0)), ["a", "k"])
    with pytest.raises(ValueError, match="s is a string"):
        fx.perturbation_plan(rows.withColumn("s", F.lit("x")), ["a", "s"])


def test_effects_against_python(rows, plan):
    got = fx.effects_long(fx.static_effects(rows, plan, {"m": ColumnScorer(linear)}, [None, 0.5]))
    data = {r["case"]: r for r in rows.collect()}
    seen = 0
    for r in got.collect():
        x = {f: data[r["case"]][f] for f in FEATURES}
        score = lambda v: sigmoid(0.3 + 0.8 * v["a"] - 0.5 * v["b"] + 0.4 * v["c"])
        new = dict(x)
        if r["feature"] == "c":
            new["c"] = 1.0 - x["c"]
        else:
            new[r["feature"]] = 0.0 if r["baseline"] is None else x[r["feature"]] * 0.5
        assert r["orig_prob"] == pytest.approx(score(x))
        assert r["perturb_prob"] == pytest.approx(score(new))
        assert r["effect"] == pytest.approx(logit(score(new)) - logit(score(x)), abs=1e-9)
        seen += 1
    assert seen == 60 * 3 * 2


def test_batch_and_vote_scorers_agree_with_columns(rows, plan):
    def predict(batch: pd.DataFrame):
        z = 0.3 + 0.8 * batch["a"] - 0.5 * batch["b"] + 0.4 * batch["c"]
        return 1 / (1 + (-z).map(math.exp))

    scorers = {
        "col": ColumnScorer(linear),
        "batch": BatchScorer(predict, FEATURES),
        "vote": VoteScorer([ColumnScorer(linear), BatchScorer(predict, FEATURES)]),
    }
    by_key = {}
    for r in fx.effects_long(fx.static_effects(rows, plan, scorers)).collect():
        by_key.setdefault((r["case"], r["feature"]), []).append(r["effect"])
    assert all(max(v) - min(v) < 1e-9 and len(v) == 3 for v in by_key.values())


def test_norm_is_one_and_null_for_a_flat_model(rows, plan):
    scorers = {"m": ColumnScorer(linear), "flat": ColumnScorer(lambda v: F.lit(0.4))}
    long = fx.effects_long(fx.normalize_effects(fx.static_effects(rows, plan, scorers)))
    norms = long.groupBy("case", "model").agg(F.sum(F.pow("effect", 2)).alias("n"), F.count("effect").alias("k"))
    for r in norms.collect():
        if r["model"] == "m":
            assert r["n"] == pytest.approx(1.0)
        else:
            assert r["n"] is None and r["k"] == 0
    part = fx.effects_long(fx.normalize_effects(fx.static_effects(rows, plan, scorers), ["a", "b"]))
    chosen = part.where("model = 'm' and feature in ('a', 'b')").groupBy("case").agg(F.sum(F.pow("effect", 2)))
    assert all(r[1] == pytest.approx(1.0) for r in chosen.collect())


def test_stored_effects_come_back_as_a_panel(spark, rows, plan):
    scorers = {"m": ColumnScorer(linear), "s": ColumnScorer(steep)}
    panel = fx.static_effects(rows, plan, scorers)
    long = fx.effects_long(panel)
    back = fx.effects_long(fx.panel_from_long(long, ["m", "s"], FEATURES))
    key = lambda r: (r["case"], r["model"], r["feature"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
    missing = long.where("not (case = 3 and model = 's')")
    assert fx.panel_from_long(missing, ["m", "s"], FEATURES).count() == 59
    assert len({key(r) for r in long.collect()}) == 360
    assert set(EFFECTS.fieldNames()) - {"baseline"} == set(long.columns)


def test_every_row_is_kept_at_any_width(spark):
    """Repeated keys and null features: as many rows out as in, each scored from its own values."""
    for width, batch in ((5, 16), (32, 16), (32, 7)):
        names = [f"f{i}" for i in range(width)]
        values = [(1, 0, *([1.0] * width)), (1, 0, *([2.0] * width)), (2, 0, None, *([1.0] * (width - 1)))]
        kinds = "case long, timepoint int, " + ", ".join(f"{n} double" for n in names)
        df = spark.createDataFrame(values, kinds)
        risk = lambda v, k: 1.0 / (1.0 + F.exp(-k * sum((v[n] for n in names), F.lit(0.0))))
        scorers = {f"m{k}": ColumnScorer(lambda v, k=k: risk(v, k / 10)) for k in range(1, 5)}
        fx.BATCH, kept = batch, fx.BATCH
        try:
            got = fx.static_effects(df, [fx.Perturbation(n) for n in names], scorers, carry=["f1"]).collect()
        finally:
            fx.BATCH = kept
        assert len(got) == 3
        for r in got:
            for k, m in enumerate(r.panel, 1):
                assert [e.feature for e in m.effects] == names
                if r.case == 2:
                    # Setting the missing value is the only variant without a null.
                    assert m.orig_prob is None and [e.perturb_prob is None for e in m.effects] == [False] + [True] * (width - 1)
                else:
                    want = 1 / (1 + np.exp(-k / 10 * r.f1 * (width - 1)))
                    assert all(e.perturb_prob == pytest.approx(want) for e in m.effects)


def test_thirty_features(spark):
    names = [f"f{i}" for i in range(30)]
    df = spark.range(20).select(
        F.col("id").alias("case"), F.lit(0).alias("timepoint"),
        *[(F.col("id") * (i + 1) % 7 - 3.0).alias(n) for i, n in enumerate(names)],
    )
    total = lambda v: sum((v[n] * (0.1 * (i % 5) - 0.2) for i, n in enumerate(names)), F.lit(0.0))
    scorers = {m: ColumnScorer(lambda v, k=k: 1.0 / (1.0 + F.exp(-k * total(v)))) for m, k in (("x", 0.5), ("y", 1.0))}
    frame = panel_frame(df, [fx.Perturbation(n) for n in names], scorers, rank=3)
    assert votes.consensus_rows(frame).where("winner is not null").count() > 0


def test_joined_and_wide_names(rows, plan):
    one = fx.static_effects(rows, plan, {"m": ColumnScorer(linear)})
    two = fx.static_effects(rows.where("case < 50"), plan, {"s": ColumnScorer(steep)})
    joined = fx.join_model_effects(one, two, features=["a", "c"], labels=rows.select("case", "timepoint", "label"))
    wide = fx.effects_wide(joined, ["m", "s"], ["a", "c"])
    assert wide.count() == 50
    assert {"m_a", "s_c", "perturb_a_prob_m", "orig_prob_s", "label"} <= set(wide.columns)
    with pytest.raises(ValueError):
        fx.join_model_effects(one, features=["a"])


@pytest.mark.parametrize("reverse", [True, False])
def test_series_effects_against_python(spark, reverse):
    rng = random.Random(4)
    data = [(c, t, rng.gauss(0, 1), rng.gauss(0, 1)) for c in range(6) for t in range(8) if rng.random() < 0.7]
    df = spark.createDataFrame(data, '`case` bigint, timepoint int, a double, b double')

    def scorer(steps):
        parts = F.transform(steps, lambda s, i: (i + 1) * (0.2 * s["a"] - 0.1 * s["b"]))
        return 1.0 / (1.0 + F.exp(-F.aggregate(parts, F.lit(0.05), lambda acc, x: acc + x)))

    plan = [fx.Perturbation("a"), fx.Perturbation("b", epsilon=0.5)]
    got = fx.effects_long(fx.series_effects(df, plan, {"q": scorer}, 8, reverse=reverse)).collect()
    assert len(got) == 2 * len(data)

    def score(steps):
        return sigmoid(0.05 + sum((i + 1) * (0.2 * a - 0.1 * b) for i, (a, b) in enumerate(steps)))

    for r in got:
        mine = sorted((x for x in data if x[0] == r["case"]), key=lambda x: -x[1])
        past = [x for x in mine if (x[1] >= r["timepoint"] if reverse else x[1] <= r["timepoint"])]
        orig = [(a, b) for _, _, a, b in past]
        changed = [
            ((0.0, b) if r["feature"] == "a" else (a, 0.5)) if t == r["timepoint"] else (a, b)
            for _, t, a, b in past
        ]
        assert r["orig_prob"] == pytest.approx(score(orig))
        assert r["perturb_prob"] == pytest.approx(score(changed))
    with pytest.raises(PySparkException):
        fx.series_effects(df, plan, {"q": scorer}, 2).collect()


def panel_of(spark, models):
    """One-row panel frame from {model: (orig, {feature: (new, effect)})}."""
    rows = [(m, orig, [(f, p, g) for f, (p, g) in e.items()]) for m, (orig, e) in models.items()]
    return spark.createDataFrame(
        [(1, 0, rows)],
        "`case` bigint, timepoint int, panel array<struct<model:string,orig_prob:double,"
        "effects:array<struct<feature:string,perturb_prob:double,effect:double>>>>",
    )


def test_rank_order_ties_and_not_found(spark):
    panel = panel_of(spark, {"m": (0.6, {"a": (0.5, -0.2), "b": (0.5, -0.2), "c": (0.6, 0.0), "d": (0.7, 0.3), "e": (0.6, None)})})
    long = ranking.ranks_long(ranking.rank_effects(panel, 5))
    got = [(r["rank"], r["feature"], r["effect"]) for r in long.orderBy("rank").collect()]
    assert got == [(1, "b", -0.2), (2, "a", -0.2), (3, "c", 0.0), (4, "not_found", None), (5, "not_found", None)]
    wide = ranking.ranks_wide(ranking.rank_effects(panel, 1), ["m"], 1)
    assert wide.columns == ["case", "timepoint", "m_effect", "m_feat"] and wide.first()["m_feat"] == "b"
    with pytest.raises(ValueError):
        ranking.rank_effects(panel, 3, features=["a", "b"])


def test_votes(spark):
    panel = panel_of(
        spark,
        {
            "x": (0.6, {"a": (0.3, -0.5), "b": (0.5, -0.3), "c": (0.8, 0.2)}),
            "y": (0.8, {"a": (0.7, -0.1), "b": (0.4, -0.3), "c": (0.9, 0.1)}),
            "z": (0.5, {"a": (0.9, 0.4), "b": (0.6, 0.3), "c": (0.7, 0.2)}),
        },
    )
    ranked = ranking.rank_effects(panel, 3)
    vote = lambda **kw: votes.consensus_rows(votes.with_consensus(ranked, ["a", "b", "c"], **kw)).first()
    tie = vote()  # 0.6 for both: the smaller name wins
    assert (tie["winner"], tie["consensus"], tie["models"]) == ("a", 2, ["x", "y"])
    assert tie["score"] == pytest.approx(0.6)
    assert tie["avg_percent_consensus"] == pytest.approx((50.0 + 12.5) / 2, abs=1e-3)
    assert tie["avg_percent_all"] == pytest.approx((50.0 + 12.5 - 80.0) / 3, abs=1e-3)
    assert vote(weights={"x": 1.0, "y": 2.0, "z": None})["winner"] == "b"
    one = ranking.rank_effects(panel, 1)
    assert votes.consensus_rows(votes.with_consensus(one, ["a", "b", "c"], policy="mean")).first()["winner"] == "a"
    with pytest.raises(ValueError):
        votes.with_consensus(ranked, ["a"], policy="max")
    harmful = ranking.rank_effects(panel_of(spark, {"x": (0.5, {"a": (0.9, 0.4)})}), 1)
    none = votes.consensus_rows(votes.with_consensus(harmful, ["a"])).first()
    assert none["winner"] is None and none["consensus"] is None and none["avg_percent_all"] is None
    with_rbo = votes.with_consensus(ranking.with_rbos(ranked, ["x", "y", "z"], 3), ["a", "b", "c"])
    both = votes.consensus_with_overlap(with_rbo).first()
    assert both["rbo_min"] == both["rbo_max"] and both["rbo_min"] is not None
    single = ranking.with_rbos(one, ["x", "y", "z"], 1)
    assert votes.consensus_with_overlap(votes.with_consensus(single, ["a", "b", "c"])).first()["rbo_min"] is None


def test_row_summaries(spark):
    panel = panel_of(
        spark,
        {"x": (0.6, {"a": (0.7, -0.5), "b": (0.65, -0.9)}), "y": (0.8, {"a": (0.9, 0.2), "b": (0.85, 0.1)})},
    )
    best = votes.best_feature(panel, ["a", "b"]).first()
    assert (best["best_feat"], best["new_risk"]) == ("a", pytest.approx(0.8))  # nothing helps: first declared
    assert (best["rank_feat"], best["rank_val"]) == ("b", pytest.approx(-0.8))
    count = lambda **kw: panel.select(votes.threshold_count(F.lit(0.7), ["x", "y"], **kw)).first()[0]
    assert count(threshold=0.68) == 2 and count(threshold=0.8) == 0
    assert count(threshold=0.69, direction="below") == 1 and count(features=["b"], threshold=0.66) == 1
    flat = spark.createDataFrame([(-2.0, 2.0, 1.0)], "a double, b double, c double")
    assert flat.select(votes.most_abnormal(["a", "b", "c"])).first()[0] == "a"
    table = reports.panel_table(panel, ["x", "y"], ["a", "b"], ensemble="y").collect()
    assert sorted((r["model"], r["feature"], r["value"]) for r in table) == [
        ("SUM", "a", -0.5), ("SUM", "b", -0.9), ("X", "a", -0.5), ("X", "b", -0.9)]
    half = spark.createDataFrame([(0.5,)], "p double")
    assert half.select(predict_class(F.col("p")), predict_class(F.col("p"), 0.5, True)).first()[:] == (0, 1)


def test_sweep_covers_static_and_series_models(spark, tmp_path):
    data = [(c, t, 0.3 * c - 0.1 * t, 0.2 * t) for c in range(4) for t in range(3)]
    df = spark.createDataFrame(data, '`case` bigint, timepoint int, a double, b double')
    plan = [fx.Perturbation("a"), fx.Perturbation("b")]
    last = lambda s: 1.0 / (1.0 + F.exp(-F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x["a"] + x["b"])))
    run_sweep(df, plan, {"m": ColumnScorer(lambda v: 1.0 / (1.0 + F.exp(-(v["a"] - v["b"]))))}, str(tmp_path / "out"),
              {"seq": last}, 3)
    schema = "`case` bigint, timepoint int, feature string, orig_prob double, perturb_prob double, effect double, model string, perturb string"
    from pyspark.sql.types import StructType

    back = read_sweep_csv(spark, str(tmp_path / "out"), StructType.fromDDL(schema))
    counts = {(r["model"], r["perturb"]): r["count"] for r in back.groupBy("model", "perturb").count().collect()}
    assert counts == {(m, p): 24 for m in ("m", "seq") for p in ("full", "0.5", "0.7", "0.9")}


def test_panel_plan_has_no_shuffle_python_or_cartesian(rows, plan):
    frame = panel_frame(rows, plan, {"m": ColumnScorer(linear), "s": ColumnScorer(steep)})
    text = frame._jdf.queryExecution().executedPlan().toString()
    for bad in ("Exchange", "Python", "Cartesian", "NestedLoop", "Sort ", "Window"):
        assert bad not in text, bad
    assert frame.count() == 60


def test_forward_fill_across_chunks_and_padding(spark):
    rng = random.Random(9)
    data = [(c, t, rng.random() if rng.random() < 0.3 else None, c + t) for c in (1, 2) for t in range(40)]
    df = spark.createDataFrame(data, '`case` bigint, timepoint int, a double, outcome int')
    got = {(r["case"], r["timepoint"]): r["a"] for r in values.forward_fill_series(df, ["a"], chunk_steps=4).collect()}
    for c in (1, 2):
        last = None
        for t in range(39, -1, -1):
            x = next(d[2] for d in data if d[0] == c and d[1] == t)
            last = x if x is not None else last
            assert got[(c, t)] == last
    final = {r["case"]: r["a"] for r in values.last_value_features(df, ["a"], "outcome").collect()}
    assert final == {c: got[(c, 0)] for c in (1, 2)}
    first = values.last_value_features(df, ["a"], "outcome", last=False).where("case = 1").first()
    assert first["a"] == next(d[2] for d in sorted(data, key=lambda d: -d[1]) if d[0] == 1 and d[2] is not None)
    assert first["label"] == 1  # still the label of the last row
    short = values.sequence_pad(df.fillna(0.0).where("timepoint < 3 or case = 1"), ["a"]).where("case = 2").first()
    assert len(short["a"]) == 40 and short["a"][3:] == [0.0] * 37
    with pytest.raises(PySparkException):
        values.sequence_pad(df, ["a"], length=5).collect()
    assert score_rows(df.fillna(0.0), ["a"], {"k": ColumnScorer(lambda v: v["a"])}).count() == 80
