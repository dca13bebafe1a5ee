"""Plans that have to hold when one key owns a large share of the rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tiltframe.operators import measurements
from tiltframe.operators.ventilation import vent_settings
from tiltframe.plans import extraction
from tiltframe.session import setting, tune
from workload import fixtures
from workload.queries import QUERIES, _clinical

T0 = dt.datetime(2101, 3, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_stay_is_split_at_run_time(spark):
    """A third of the readings belong to one stay: its join partition is read in slices."""
    n = 60000
    stay = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    readings = spark.range(n).select(
        F.lit(1).alias("subject_id"), F.lit(1).alias("hadm_id"), stay.alias("icustay_id"),
        F.lit(211).alias("itemid"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 1200).cast("int"))).alias("charttime"),
        F.rand(3).alias("valuenum"), F.lit(None).cast("int").alias("error"),
    ).withColumn("valuenum", F.col("valuenum") + 60)
    stays = spark.range(500).select(
        F.lit(1).alias("subject_id"), F.lit(1).alias("hadm_id"), F.col("id").alias("icustay_id"),
        F.lit(T0).cast("timestamp_ntz").alias("intime"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = measurements.first_day_vitals(stays, readings, 24)
        assert df.count() == 500 and df.agg(F.sum("subject_id")).first()[0] == 500
        df.collect()
        assert "skew=true" in plan_of(df)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = QUERIES["case_lookup"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in text
    scores = QUERIES["evaluate_models"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in scores and "o_totalprice" not in scores


def test_settings_are_reduced_before_the_shuffle(spark, sf):
    df = vent_settings(fixtures.chartevents(spark, sf), fixtures.procedures(spark, sf))
    assert "partial_max" in plan_of(df)


def test_core_queries_have_no_python_and_no_cartesian_product(spark, sf):
    for name in ("model_panel", "series_effects", "ventilation_episodes", "first_day_labs", "comorbidity_flags"):
        text = plan_of(QUERIES[name](spark, sf))
        for bad in ("EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "NestedLoop"):
            assert bad not in text, (name, bad)


def test_episodes_shuffle_by_day_and_not_again(spark, sf):
    """One state per day: no more than ten exchanges, each input read once."""
    df = QUERIES["ventilation_episodes"](spark, sf)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bExchange ", final)) <= 10
    assert final.count("FileScan") <= 3


def test_correlations_have_one_plan_for_any_number_of_pairs(spark):
    from tiltframe.functions.sums import matrix_sums

    wide = spark.range(50).select(*[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(64)])
    assert matrix_sums(wide, wide.columns, lambda x: x.T @ x).shape == (64, 64)
    assert matrix_sums(wide.limit(0), wide.columns, lambda x: x.sum(0)).tolist() == [0.0] * 64


def test_exploded_events_are_not_shuffled_again(spark, sf):
    """Events derived from lines lie by admission already: stays come to them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(QUERIES["first_day_vitals"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Lines, orders twice, and the partial sums.
    assert len(re.findall(r"\bExchange ", text)) == 4, text


def test_pieces_do_not_grow_with_the_input(spark, sf):
    """The session asks for 4 shuffle partitions; a task of an event query still gets about 12 MB at most.
    Other queries find the session as it was."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = tune(spark).conf.get(size)
    text = plan_of(QUERIES["ventilation_episodes"](spark, sf))
    assert ", 1600)" in text and ", 4)" not in text
    assert spark.conf.get(size) != before
    QUERIES["case_lookup"](spark, sf)
    assert spark.conf.get(size) == before
    rows = spark.range(1000).repartition("id")
    assert ", 4)" in plan_of(rows)


def below(plan, line):
    """The lines of a plan tree below one of its lines."""
    depth = lambda text: len(text) - len(text.lstrip(" :+-"))
    lines = plan.splitlines()
    found = []
    for text in lines[lines.index(line) + 1 :]:
        if depth(text) <= depth(line):
            break
        found.append(text)
    return "\n".join(found)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_broadcasts(spark):
    """As with tables that are too large for it."""
    tune(spark)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        with setting(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", "-1"):
            yield


def test_settings_of_other_stays_are_reduced_then_left_out_before_they_are_sorted(spark, sf, no_broadcasts):
    plan = optimized(extraction.cohort(_clinical(spark, sf)))
    windows = [line for line in plan.splitlines() if "Window " in line and "__day" in line]
    assert windows
    for line in windows:
        rest = below(plan, line)
        semi = [line for line in rest.splitlines() if "Join LeftSemi" in line]
        assert any("Aggregate [icustay_id" in below(rest, line) for line in semi)


def test_first_labs_are_computed_once_for_the_hourly_rows(spark, sf):
    events = spark.range(20).select(
        F.col("id").alias("subject_id"), F.col("id").alias("hadm_id"), F.col("id").alias("icustay_id"),
        F.lit(T0).cast("timestamp_ntz").alias("event_time"), F.lit(1).alias("ventilated"),
        F.lit(T0).cast("timestamp_ntz").alias("mv_start"),
    )
    hourly = measurements.hourly_vitals_labs(events, fixtures.labevents(spark, sf), fixtures.chartevents(spark, sf))
    assert optimized(hourly).count("Join Inner, (l_orderkey") == 1


def test_joins_of_small_pieces_do_not_sort(spark, sf, no_broadcasts):
    """Two sorters a join take a page of memory each, however few their rows."""
    df = QUERIES["stay_demographics"](spark, sf)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final
