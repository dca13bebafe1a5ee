"""Notes and prescriptions around an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.functions.chunked import row_positions
from tiltframe.functions.scalar import hours

NOTE_SEPARATOR = "\n***NEXT NOTE***\n\n"  # fixed value


def event_keys(events: DataFrame) -> DataFrame:
    return events.select("subject_id", "hadm_id", "event_time").distinct()


def notes_before_event(
    notes: DataFrame, events: DataFrame, prior_hours: int | None = None
) -> DataFrame:
    """Notes of the last ``prior_hours`` hours up to the event (both ends included), or all
    strictly before it."""
    joined = notes.join(event_keys(events), ["subject_id", "hadm_id"])
    if prior_hours is None:
        near = F.col("charttime") < F.col("event_time")
    else:
        near = F.col("charttime").between(
            F.col("event_time") - hours(prior_hours), F.col("event_time")
        )
    return joined.where(near).select(
        F.col("row_id").alias("note_id"),
        "subject_id",
        "hadm_id",
        "chartdate",
        "charttime",
        "category",
        "text",
    )


def meds_before_event(
    prescriptions: DataFrame, events: DataFrame, prior_hours: int | None = None
) -> DataFrame:
    """Prescriptions that lie within the window before the event, or that ended by the event."""
    joined = prescriptions.join(event_keys(events), ["subject_id", "hadm_id"])
    near = F.col("enddate") <= F.col("event_time")
    if prior_hours is not None:
        near = near & (F.col("startdate") >= F.col("event_time") - hours(prior_hours))
    drug_columns = [
        c
        for c in prescriptions.columns
        if c not in ("row_id", "subject_id", "hadm_id", "startdate", "enddate")
    ]
    return joined.where(near).select(
        F.col("row_id").alias("note_id"),
        "subject_id",
        "hadm_id",
        "startdate",
        "enddate",
        *drug_columns,
    )


def note_digest(notes: DataFrame, separator: str = NOTE_SEPARATOR) -> DataFrame:
    """The notes of every subject in time order, one row per note: read in ``position`` order the
    ``block`` texts are the joined digest.

    Texts stay in separate rows because the digest of one subject has no size limit; a subject is
    sorted by calendar day. Notes without a time come last; notes without a subject are in no digest.
    """
    keyed = notes.where(F.col("subject_id").isNotNull())
    keyed = keyed.withColumn("__day", F.to_date("charttime"))
    placed = row_positions(keyed, ["subject_id"], "__day", ["charttime", "row_id"], "position")
    first = F.col("position") == 1
    return placed.select(
        "subject_id",
        "position",
        F.col("row_id").alias("note_id"),
        F.when(first, F.col("text"))
        .otherwise(F.concat(F.lit(separator), F.col("text")))
        .alias("block"),
    )
