import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tiltframe.codes import COMORBIDITY_CODES
from tiltframe.operators import comorbidity, measurements, records, visits
from tiltframe.operators.ventilation import ventilation_episodes
from tiltframe.plans import extraction

T0 = dt.datetime(2101, 3, 1, 20)
CHART = (
    "subject_id bigint, hadm_id bigint, icustay_id bigint, itemid int, charttime timestamp_ntz, "
    "value string, valuenum double, error int"
)
PROC = "icustay_id bigint, starttime timestamp_ntz, itemid int"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def vent(stay, hours, item=720, value="SIMV", error=None):
    return (1, 1, stay, item, at(hours), value, 1.0, error)


def episodes(spark, chart, proc=()):
    df = ventilation_episodes(spark.createDataFrame(chart, CHART), spark.createDataFrame(list(proc), PROC))
    hours = lambda t: (t - T0).total_seconds() / 3600
    return sorted(
        ((r["icustay_id"], r["ventnum"], hours(r["mv_start"]), hours(r["mv_end"])) for r in df.collect()),
        key=str,
    )


def test_gap_of_exactly_eight_hours_continues(spark):
    assert episodes(spark, [vent(1, 0), vent(1, 8), vent(1, 9)]) == [(1, 1, 0, 9)]
    split = episodes(spark, [vent(1, 0), vent(1, 1), vent(1, 9.01), vent(1, 10)])
    assert split == [(1, 1, 0, 1), (1, 2, pytest.approx(9.01), 10)]


def test_extubation_and_oxygen_end_an_episode(spark):
    chart = [vent(1, 0), vent(1, 1), vent(1, 2, 640, "Extubated"), vent(1, 3), vent(1, 4)]
    assert episodes(spark, chart) == [(1, 1, 0, 2), (1, 2, 3, 4)]
    chart = [vent(2, 0), vent(2, 1), vent(2, 2, 467, "Cannula"), vent(2, 3), vent(2, 4)]
    assert episodes(spark, chart) == [(2, 1, 0, 1), (2, 2, 3, 4)]
    # A procedure at the time of a setting counts after it.
    chart = [vent(3, 0), vent(3, 1), vent(3, 2), vent(3, 3)]
    assert episodes(spark, chart, [(3, at(1), 225468)]) == [(3, 1, 0, 1), (3, 2, 2, 3)]


def test_errors_unlisted_items_and_single_times_do_not_count(spark):
    chart = [vent(1, 0), vent(1, 1, error=1), vent(2, 0), vent(2, 1, error=0), vent(3, 0, 99), vent(3, 1, 99)]
    assert episodes(spark, chart) == [(2, 1, 0, 1)]
    chart = [vent(4, 0, 459, "x"), vent(4, 1, 459, "x"), vent(5, 0, 720, "Other/Remarks"), vent(5, 1, 720, "Other/Remarks")]
    assert episodes(spark, chart) == []


def brute_force(rows):
    """Episodes of one stay from (hour, mech, oxygen, extubated) rows in order."""
    num, last_vent, last_ext, spans = 0, None, 0, {}
    by_time = {}
    for h, mech, oxy, ext in rows:
        new = 0
        if (mech or ext) and last_ext:
            new = 1
        elif not mech and oxy:
            new = 1
        elif mech and last_vent is not None and h - last_vent > 8:
            new = 1
        num += new
        by_time[h] = num
        if mech:
            last_vent = h
        if mech or ext:
            last_ext = ext
    for h, mech, _, ext in rows:
        if mech or ext:
            spans.setdefault(by_time[h], []).append((h, mech))
    kept = [
        (min(h for h, _ in s), max(h for h, _ in s))
        for _, s in sorted(spans.items())
        if len({h for h, _ in s}) > 1 and any(m for _, m in s)
    ]
    return [(i, a, b) for i, (a, b) in enumerate(kept, 1)]


def test_random_stays_over_many_days_match_a_plain_loop(spark):
    rng = random.Random(11)
    chart, proc, expected = [], [], []
    for stay in [None, *range(1, 30)]:
        rows = []
        hour = 0
        for _ in range(40 if stay else 300):
            hour += rng.choice([0.5, 1, 3, 7, 8, 8.5, 15, 40])
            kind = rng.choice(["vent", "vent", "vent", "oxygen", "out", "procedure"])
            if kind == "vent":
                chart.append(vent(stay, hour))
                rows.append((hour, 1, 0, 0))
            elif kind == "oxygen":
                chart.append(vent(stay, hour, 467, "Hood"))
                rows.append((hour, 0, 1, 0))
            elif kind == "out":
                chart.append(vent(stay, hour, 640, "Self Extubation"))
                rows.append((hour, 0, 0, 1))
            else:
                proc.append((stay, at(hour), 227194))
                rows.append((hour, 0, 0, 1))
        expected += [(stay, *e) for e in brute_force(rows)]
    assert episodes(spark, chart, proc) == sorted(expected, key=str)


def test_comorbidity_flags(spark):
    rows = [(1, 1, "4280"), (1, 2, "25000"), (1, 3, "25040"), (2, 2, "40291"), (3, 2, "1629"), (3, 3, "1970"),
            (4, 2, "V6542"), (4, 3, "585"), (4, 4, "5712"), (5, None, "4280"), (6, 2, "9999")]
    diagnoses = spark.createDataFrame(rows, "hadm_id bigint, seq_num int, icd9_code string")
    admissions = spark.range(1, 8).select(F.col("id").alias("hadm_id"))
    out = {r["hadm_id"]: r.asDict() for r in comorbidity.comorbidity_flags(diagnoses, admissions).collect()}
    assert len(out) == 7 and len(out[1]) == 31
    assert out[1]["congestive_heart_failure"] == 0  # a primary code does not count
    assert (out[1]["diabetes_uncomplicated"], out[1]["diabetes_complicated"]) == (0, 1)
    assert (out[2]["hypertension"], out[2]["congestive_heart_failure"]) == (1, 1)
    assert (out[3]["solid_tumor"], out[3]["metastatic_cancer"]) == (0, 1)
    assert (out[4]["drug_abuse"], out[4]["renal_failure"]) == (1, 1)
    assert (out[4]["liver_disease"], out[4]["alcohol_abuse"]) == (1, 1)  # one code, two flags
    assert out[5]["obesity"] is None and out[5]["hypertension"] == 0
    assert out[6]["obesity"] == 0 and out[7]["aids"] is None and out[7]["solid_tumor"] == 0


def test_codes_are_written_out():
    assert COMORBIDITY_CODES["aids"] == ("042", "043", "044")
    assert len(COMORBIDITY_CODES["tumor"]) == 55 and "173" not in COMORBIDITY_CODES["tumor"]
    assert {len(c) for listed in COMORBIDITY_CODES.values() for c in listed} == {3, 4, 5}


def test_stays_without_a_time_are_kept_and_numbered_last(spark):
    icu = "subject_id bigint, hadm_id bigint, icustay_id bigint, intime timestamp_ntz, outtime timestamp_ntz, first_careunit string"
    day = lambda d: dt.datetime(2020, 1, d)
    stays = spark.createDataFrame([(1, 10, 100, day(5), day(7), "A"), (1, 10, 101, None, None, "A"), (1, 10, 102, day(2), day(3), "A")], icu)
    adm = spark.createDataFrame(
        [(1, 10, day(1), day(20), None, "d", "white", "e", 1)],
        "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, "
        "diagnosis string, ethnicity string, admission_type string, has_chartevents_data int",
    )
    people = spark.createDataFrame([(1, "M", dt.date(1960, 1, 1))], "subject_id bigint, gender string, dob date")
    got = visits.stay_demographics(stays, adm, people).collect()
    assert {r.icustay_id: r.icustay_seq for r in got} == {102: 1, 100: 2, 101: 3}


EVENTS = (
    "subject_id bigint, hadm_id bigint, icustay_id bigint, event_time timestamp_ntz, ventilated int, "
    "mv_start timestamp_ntz"
)
LABS = "subject_id bigint, hadm_id bigint, itemid int, charttime timestamp_ntz, valuenum double"


def test_first_labs(spark):
    events = spark.createDataFrame([(1, 1, 11, at(30), 0, None), (2, 2, 22, at(30), 1, at(30))], EVENTS)
    labs = spark.createDataFrame(
        [
            (1, 1, 50809, at(1), 100.0), (1, 1, 50931, at(1), 120.0), (1, 1, 50931, at(2), 300.0),  # tie: larger
            (1, 1, 50862, at(3), 11.0), (1, 1, 50862, at(4), 4.0),  # implausible first value
            (1, 1, 50813, at(27), 2.0),  # not before the lead
            (1, 1, 51006, at(5), -1.0), (1, 1, 51006, at(6), 9.0),  # not positive: not a measurement
            (2, 2, 50813, at(28), 2.0),  # nothing early enough: the stay drops out
        ],
        LABS,
    )
    got = [r.asDict() for r in measurements.first_labs_before_event(events, labs, 3).collect()]
    assert len(got) == 1 and got[0]["icustay_id"] == 11
    assert (got[0]["glucose"], got[0]["albumin"], got[0]["lactate"], got[0]["bun"]) == (120.0, None, None, 9.0)


def test_first_day_tables_keep_or_drop_empty_stays(spark):
    stays = spark.createDataFrame(
        [(1, 1, 11, T0), (2, 2, 22, T0)], "subject_id bigint, hadm_id bigint, icustay_id bigint, intime timestamp_ntz"
    )
    labs = spark.createDataFrame([(1, 1, 50813, at(-6), 2.0), (1, 1, 50813, at(-5), 3.0), (1, 1, 51006, at(24), 7.0)], LABS)
    got = sorted((r["icustay_id"], str(r["lab_date"]), r["lactate"], r["bun"])
                 for r in measurements.first_day_labs(stays, labs, 24).collect())
    assert got == [(11, "2101-03-01", 2.0, None), (11, "2101-03-02", None, 7.0), (22, "None", None, None)]
    chart = [(1, 1, 11, 678, at(0), None, 98.6, None), (1, 1, 11, 678, at(1), None, 50.0, None),
             (1, 1, 11, 211, at(24), None, 80.0, 1), (1, 1, 11, 646, at(2), None, 100.0, None)]
    vitals = measurements.first_day_vitals(stays, spark.createDataFrame(chart, CHART), 24).collect()
    assert len(vitals) == 1
    assert vitals[0]["tempc_mean"] == pytest.approx(37.0) and vitals[0]["spo2_max"] == 100.0
    assert vitals[0]["heartrate_mean"] is None


def test_demographics_cleaning(spark):
    rows = [("WHITE - X", 30.0, 27), ("MIXED BLACK", 30.0, 30), ("LATIN", 30.0, 30), (None, 30.0, 30),
            ("UNKNOWN", 30.0, 30), ("ASIAN", 301.0, 30), ("ASIAN", 30.0, 26.99)]
    demo = spark.createDataFrame(
        [(e, a, T0, at(h), "M", "NICU", 1, 1) for e, a, h in rows],
        "ethnicity string, age double, intime timestamp_ntz, outtime timestamp_ntz, gender string, "
        "first_careunit string, hospstay_seq int, icustay_seq int",
    )
    got = visits.clean_demographics(demo, 27)
    assert sorted(r["ethnicity"] for r in got.collect()) == ["MIXED BLACK", "hispanic", "other", "other", "white"]
    assert "icustay_seq" not in got.columns
    assert {(r["adult_icu"], r["gender"]) for r in got.collect()} == {(0, 1)}


def test_note_windows_and_digest(spark):
    notes = spark.createDataFrame(
        [(i, 1, 1, T0.date(), at(h), "c", f"note {i}") for i, h in enumerate([52, 2, 50, 1.9])],
        "row_id bigint, subject_id bigint, hadm_id bigint, chartdate date, charttime timestamp_ntz, category string, text string",
    )
    events = spark.createDataFrame([(1, 1, at(50))] * 2, "subject_id bigint, hadm_id bigint, event_time timestamp_ntz")
    near = records.notes_before_event(notes, events, 48)
    assert sorted(r["note_id"] for r in near.collect()) == [1, 2]
    older = records.notes_before_event(notes, events)
    assert sorted(r["note_id"] for r in older.collect()) == [1, 3]
    digest = "".join(r["block"] for r in records.note_digest(notes).orderBy("position").collect())
    assert digest == "\n***NEXT NOTE***\n\n".join(["note 3", "note 1", "note 2", "note 0"])


def test_cohort_is_the_same_as_by_the_episodes_of_all_stays(spark):
    """Settings without a stay, of second stays and of second admissions neither add nor drop a stay."""
    day = lambda n: T0 + dt.timedelta(days=n)
    stays = [(10 * a + n, s, a, "MICU", day(d + 3 * n), day(d + 3 * n + 2)) for s, a, n, d in (
        (1, 1, 1, 0), (1, 1, 2, 0), (1, 2, 1, 50), (2, 3, 1, 0), (3, 4, 1, 0), (4, 5, 1, 0))]
    stays.append((None, 5, 6, "MICU", day(3), day(5)))
    adm = [(a, s, day(d), day(d + 20), None, "WHITE", "EMERGENCY", "F", 1) for a, s, d in (
        (1, 1, 0), (2, 1, 50), (3, 2, 0), (4, 3, 0), (5, 4, 0), (6, 5, 0))]
    chart = []
    for stay, start in ((11, 4), (12, 7), (21, 54), (31, 4), (41, 0), (None, 4)):
        chart += [(1, 1, stay, 720, day(start) + dt.timedelta(hours=h), "SIMV", 1.0, None) for h in (0, 1, 30, 31)]
    base = extraction.BaseTables(
        icustays=spark.createDataFrame(stays, "icustay_id bigint, subject_id bigint, hadm_id bigint, first_careunit string, intime timestamp_ntz, outtime timestamp_ntz"),
        admissions=spark.createDataFrame(adm, "hadm_id bigint, subject_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, ethnicity string, admission_type string, diagnosis string, has_chartevents_data int"),
        patients=spark.createDataFrame([(s, "M", dt.date(2060, 1, 1)) for s in range(1, 6)], "subject_id bigint, gender string, dob date"),
        services=spark.createDataFrame([(s, a, day(d) + dt.timedelta(hours=80), None, "MED") for a, s, d in (
            (1, 1, 0), (2, 1, 50), (3, 2, 0), (4, 3, 0), (5, 4, 0), (6, 5, 0))], "subject_id bigint, hadm_id bigint, transfertime timestamp_ntz, prev_service string, curr_service string"),
        chartevents=spark.createDataFrame(chart, CHART),
        procedures=spark.createDataFrame([(11, day(4) + dt.timedelta(hours=2), 225468), (None, day(4), 225468)], PROC),
        labevents=None,
        diagnoses=None,
    )
    demo = visits.clean_demographics(visits.stay_demographics(base.icustays, base.admissions, base.patients), 27)
    whole = visits.cohort_selection(demo, ventilation_episodes(base.chartevents, base.procedures), base.services)
    found = extraction.cohort(base, 27)
    assert found.columns == whole.columns
    rows = sorted(map(str, found.collect()))
    assert rows == sorted(map(str, whole.collect()))
    assert [r["icustay_id"] for r in found.orderBy("icustay_id").collect()] == [None, 11, 31, 51]
