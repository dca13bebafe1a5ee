"""Stays, demographics, cohort and study table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.codes import CHILD_UNITS, ETHNIC_PREFIXES, SURGICAL_SERVICES
from tiltframe.functions.chunked import dense_positions
from tiltframe.functions.scalar import hours

STAY = ["subject_id", "hadm_id", "icustay_id"]


def service_moves(services: DataFrame) -> DataFrame:
    return services.select("subject_id", "hadm_id", "transfertime", "prev_service", "curr_service")


def _month(time):
    return F.trunc(time.cast("date"), "month")


def stay_demographics(
    icustays: DataFrame, admissions: DataFrame, patients: DataFrame
) -> DataFrame:
    """One row per ICU stay with its admission and patient: age in whole 365-day years, lengths
    of stay in days, death in the ICU, and the sequence of hospital and ICU stays."""
    adm = admissions.where(F.col("has_chartevents_data") == 1).drop("has_chartevents_data")
    adm = adm.withColumnRenamed("subject_id", "__adm_subject")
    stays = icustays.join(adm, "hadm_id").join(patients, "subject_id")
    # Sequences number distinct times, so repeated rows of one busy subject collapse first.
    stays = dense_positions(stays, ["__adm_subject"], "admittime", _month, "hospstay_seq")
    stays = dense_positions(stays, ["hadm_id"], "intime", _month, "icustay_seq")
    days = lambda a, b: F.datediff(F.to_date(b), F.to_date(a))
    in_icu = F.col("deathtime").between(F.col("intime"), F.col("outtime"))
    return stays.select(
        *STAY,
        "gender",
        "admittime",
        "dischtime",
        "diagnosis",
        days("admittime", "dischtime").cast("double").alias("los_hospital"),
        F.expr("datediff(to_date(admittime), to_date(dob)) div 365").cast("double").alias("age"),
        "ethnicity",
        "admission_type",
        F.when(in_icu, 1).otherwise(0).alias("mort_icu"),
        "hospstay_seq",
        F.when(F.col("hospstay_seq") == 1, 1).otherwise(0).alias("first_hosp_stay"),
        "intime",
        "outtime",
        "first_careunit",
        days("intime", "outtime").cast("double").alias("los_icu"),
        "icustay_seq",
        F.when(F.col("icustay_seq") == 1, 1).otherwise(0).alias("first_icu_stay"),
    )


def clean_demographics(demo: DataFrame, min_hours: int, drop: bool = True) -> DataFrame:
    """Plausible ages, grouped ethnicity, 0/1 sex and adult unit, stays of ``min_hours`` or more.

    A text that starts with none of the groups but contains one of their names stays as it is;
    a missing ethnicity is 'other'.
    """
    text = F.lower("ethnicity")
    grouped = None
    for pattern, name in ETHNIC_PREFIXES.items():
        hit = text.rlike(pattern)
        grouped = F.when(hit, name) if grouped is None else grouped.when(hit, name)
    named_anywhere = text.rlike("white|black|hispanic|asian")
    grouped = grouped.when(named_anywhere, F.col("ethnicity")).otherwise("other")
    out = (
        demo.where(F.col("age") < 300)
        .withColumn("los_icu_hr", F.timestamp_diff("HOUR", F.col("intime"), F.col("outtime")))
        .where(F.col("los_icu_hr") >= min_hours)
        .withColumns(
            {
                "ethnicity": grouped,
                "adult_icu": F.when(F.col("first_careunit").isin(CHILD_UNITS), 0).otherwise(1),
                "gender": F.when(F.col("gender") == "M", 1).otherwise(0),
            }
        )
    )
    return out.drop("hospstay_seq", "icustay_seq") if drop else out


def first_adult_stays(demo: DataFrame) -> DataFrame:
    """First ICU stays of first hospital stays of adults, from cleaned demographics."""
    return demo.where(
        (F.col("adult_icu") == 1)
        & (F.col("first_icu_stay") == 1)
        & (F.col("first_hosp_stay") == 1)
    )


def cohort_selection(demo: DataFrame, episodes: DataFrame, services: DataFrame) -> DataFrame:
    """First ICU stay of the first hospital stay of adults on a non-surgical service, with the
    first ventilation episode if it started after the transfer and a full day or more after
    admission; one row per stay with its latest transfer (then the smaller service code).

    Input ``demo`` is cleaned. Filters that need one side only run before the joins.
    """
    eligible = first_adult_stays(demo)
    first = episodes.where(F.col("icustay_id").isNotNull() & (F.col("ventnum") == 1))
    medical = service_moves(services).where(
        F.col("curr_service").isNull() | ~F.col("curr_service").isin(SURGICAL_SERVICES)
    )
    no_episode = F.col("ventnum").isNull()
    full_day_after = F.col("mv_start") >= F.col("admittime") + hours(24)
    joined = (
        eligible.join(first, "icustay_id", "left")
        .where(no_episode | full_day_after)
        .join(medical, ["subject_id", "hadm_id"])
        .where(
            (F.col("transfertime") > F.col("admittime"))
            & (F.col("transfertime") < F.col("outtime"))
            & (no_episode | (F.col("mv_start") > F.col("transfertime")))
        )
    )
    rest = [c for c in joined.columns if c not in ("transfertime", "prev_service", "curr_service")]
    # Among equal times the smallest codes, a missing code last.
    order = [F.col("curr_service").isNull(), "curr_service", F.col("prev_service").isNull(), "prev_service"]
    latest = joined.groupBy("icustay_id").agg(
        F.min(
            F.struct(
                -F.unix_micros(F.col("transfertime").cast("timestamp")),
                *(F.col(c).alias(f"o{i}") if isinstance(c, str) else c for i, c in enumerate(order)),
                "transfertime",
                "curr_service",
                "prev_service",
            )
        ).alias("t"),
        F.first(F.struct(*[c for c in rest if c != "icustay_id"])).alias("r"),
    )
    return latest.select("icustay_id", "r.*", "t.transfertime", "t.prev_service", "t.curr_service")


def event_users(cohort: DataFrame) -> DataFrame:
    """The columns the event extraction needs."""
    return cohort.select(*STAY, "ventnum", "mv_start", "transfertime")


def event_time_assignment(
    icustays: DataFrame, users: DataFrame, window_and_lead: int
) -> DataFrame:
    """Event time: start of ventilation, else the transfer plus window and lead; 0/1 ventilated."""
    no_episode = F.col("ventnum").isNull()
    return icustays.select(*STAY).join(users, STAY).select(
        *STAY,
        F.when(no_episode, F.col("transfertime") + hours(window_and_lead))
        .otherwise(F.col("mv_start"))
        .alias("event_time"),
        F.when(no_episode, 0).otherwise(1).alias("ventilated"),
        "mv_start",
    )


def study_table(hourly: DataFrame, cohort: DataFrame, comorbidity: DataFrame) -> DataFrame:
    """Hourly rows with the cohort columns and the comorbidity flags of the admission."""
    return hourly.join(cohort.drop("mv_start"), STAY).join(comorbidity, "hadm_id", "left")


def case_lookup(admissions: DataFrame, subject_id: int | Sequence[int]) -> DataFrame:
    """Admissions of one subject (or of several)."""
    wanted = [subject_id] if isinstance(subject_id, int) else list(subject_id)
    return admissions.where(F.col("subject_id").isin(wanted))
