"""Laboratory values and vital signs of a stay.

"First value of a label" is an aggregate (the least (time, value) pair), not a window, so map
tasks already reduce a busy stay. Grouping uses icustay_id without the other join keys: the
adaptive skew split of the join then stays possible, and partial sums cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltframe.codes import FAHRENHEIT_ITEMS, LABS, VITALS
from tiltframe.functions.scalar import elapsed_hours, hours
from tiltframe.operators.visits import STAY
from tiltframe.session import new_table_path
from tiltframe.sources.tables import replace_table

LAB_ITEMS = [i for items, _ in LABS.values() for i in items]
VITAL_ITEMS = [i for ranges in VITALS.values() for items, *_ in ranges for i in items]


def labelled_labs(labevents: DataFrame) -> DataFrame:
    """Listed items with a positive value: label, and the value or null when implausible."""
    label, value = None, None
    for name, (items, cap) in LABS.items():
        hit = F.col("itemid").isin(items)
        capped = F.when(F.col("valuenum") <= cap, F.col("valuenum"))
        label = F.when(hit, name) if label is None else label.when(hit, name)
        value = F.when(hit, capped) if value is None else value.when(hit, capped)
    return labevents.where(F.col("itemid").isin(LAB_ITEMS) & (F.col("valuenum") > 0)).select(
        "subject_id", "hadm_id", "charttime", label.alias("label"), value.alias("value")
    )


def _first_measurement() -> Column:
    """Least time; at that time the largest known value."""
    value = F.col("value")
    return F.min(F.struct("charttime", value.isNull().alias("unknown"), (-value).alias("minus")))


def _lab_columns() -> list[Column]:
    return [F.max(F.when(F.col("label") == name, F.col("value"))).alias(name) for name in LABS]


def first_labs_before_event(events: DataFrame, labevents: DataFrame, lead: int) -> DataFrame:
    """One row per stay: the first value of each of 20 labels, when it was measured earlier than
    ``lead`` hours before the event. A label first measured later is absent, an implausible first
    value is null, and a stay without any such label is dropped.

    ``events`` is the output of ``event_time_assignment`` (one row per stay).
    """
    joined = events.join(labelled_labs(labevents), ["subject_id", "hadm_id"])
    carried = [F.min(c).alias(c) for c in ("subject_id", "hadm_id", "ventilated", "mv_start")]
    first = (
        joined.groupBy("icustay_id", "event_time", "label")
        .agg(_first_measurement().alias("f"), *carried)
        .where(F.col("f.charttime") < F.col("event_time") - hours(lead))
        .withColumn("value", -F.col("f.minus"))
    )
    return (
        first.groupBy("icustay_id", "event_time")
        .agg(*carried, *_lab_columns())
        .select(*STAY, "event_time", "ventilated", "mv_start", *LABS)
    )


def vital_readings(chartevents: DataFrame) -> DataFrame:
    """Vital-sign rows not marked as errors: stay, time, vital (null when out of range), value
    in Celsius where it is a temperature."""
    raw, vital = F.col("valuenum"), None
    for name, ranges in VITALS.items():
        for items, above, below, closed in ranges:
            hit = F.col("itemid").isin(items) & (raw > above)
            if below is not None:
                hit = hit & ((raw <= below) if closed else (raw < below))
            vital = F.when(hit, name) if vital is None else vital.when(hit, name)
    celsius = F.when(F.col("itemid").isin(FAHRENHEIT_ITEMS), (raw - 32) / 1.8).otherwise(raw)
    listed = F.col("itemid").isin(VITAL_ITEMS) & ~F.col("error").eqNullSafe(1)
    return chartevents.where(listed).select(
        *STAY, "charttime", vital.alias("vital"), celsius.alias("value")
    )


def _vital(name: str) -> Column:
    return F.when(F.col("vital") == name, F.col("value"))


def hourly_vitals_labs(
    events: DataFrame,
    labevents: DataFrame,
    chartevents: DataFrame,
    window_and_lead: int = 27,
    lead: int = 3,
) -> DataFrame:
    """One row per stay and hour to the event: mean vitals of the window before the lead, with
    the stay's first labs. Stays without labs or without vitals rows do not appear."""
    labs = first_labs_before_event(events, labevents, lead)
    # Read twice; as a table, its size is known when the readings are joined.
    labs = replace_table(labs, new_table_path(events.sparkSession, "first-labs"))
    # Only the stay key and the event time enter the large join; labs are added to its result.
    cohort = labs.select(*STAY, "event_time")
    near = F.col("charttime").between(
        F.col("event_time") - hours(window_and_lead), F.col("event_time") - hours(lead)
    )
    to_event = F.round(F.abs(elapsed_hours(F.col("charttime"), F.col("event_time")))).cast("int")
    hourly = (
        vital_readings(chartevents)
        .join(cohort, STAY)
        .where(near)
        .groupBy("icustay_id", to_event.alias("timepoint"))
        .agg(*[F.avg(_vital(name)).alias(f"{name}_mean") for name in VITALS])
    )
    return hourly.join(labs, "icustay_id").select(
        *STAY,
        "timepoint",
        "event_time",
        "ventilated",
        "mv_start",
        *LABS,
        *[f"{name}_mean" for name in VITALS],
    )


def first_day_labs(icustays: DataFrame, labevents: DataFrame, within_hours: int = 24) -> DataFrame:
    """Per stay and calendar date: the first value of each label from 6 hours before ICU entry to
    ``within_hours`` after it. A stay without labs keeps one row with a null date."""
    stays = icustays.select(*STAY, "intime")
    near = F.col("charttime").between(
        F.col("intime") - hours(6), F.col("intime") + hours(within_hours)
    )
    first = (
        stays.join(labelled_labs(labevents), ["subject_id", "hadm_id"])
        .where(near)
        .groupBy("icustay_id", "label")
        .agg(_first_measurement().alias("f"))
        .select(
            "icustay_id",
            "label",
            F.to_date("f.charttime").alias("lab_date"),
            (-F.col("f.minus")).alias("value"),
        )
    )
    dated = first.groupBy("icustay_id", "lab_date").agg(*_lab_columns())
    return stays.drop("intime").join(dated, "icustay_id", "left").select(*STAY, "lab_date", *LABS)


def first_day_vitals(
    icustays: DataFrame, chartevents: DataFrame, within_hours: int = 24
) -> DataFrame:
    """Per stay and calendar date: least, greatest and mean of each vital in the first
    ``within_hours`` hours."""
    near = F.col("charttime").between(F.col("intime"), F.col("intime") + hours(within_hours))
    parts = []
    for name in VITALS:
        parts += [
            F.min(_vital(name)).alias(f"{name}_min"),
            F.max(_vital(name)).alias(f"{name}_max"),
            F.avg(_vital(name)).alias(f"{name}_mean"),
        ]
    carried = [F.min(c).alias(c) for c in ("subject_id", "hadm_id")]
    out = (
        vital_readings(chartevents)
        .join(icustays.select(*STAY, "intime"), STAY)
        .where(near)
        .groupBy("icustay_id", F.to_date("charttime").alias("lab_date"))
        .agg(*carried, *parts)
    )
    return out.select(
        *STAY, "lab_date", *[f"{n}_{s}" for n in VITALS for s in ("min", "max", "mean")]
    )
