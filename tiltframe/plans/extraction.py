"""From base tables to the study table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tiltframe.operators import comorbidity, measurements, visits
from tiltframe.operators.ventilation import ventilation_episodes
from tiltframe.session import new_table_path
from tiltframe.sources.tables import replace_table


@dataclass(frozen=True)
class BaseTables:
    icustays: DataFrame
    admissions: DataFrame
    patients: DataFrame
    services: DataFrame
    chartevents: DataFrame
    procedures: DataFrame
    labevents: DataFrame
    diagnoses: DataFrame


def cohort(
    base: BaseTables, min_hours: int = 27, gap_hours: int = 8, demo: DataFrame | None = None
) -> DataFrame:
    """Demographics, ventilation episodes and transfers to one row per selected stay.

    The stays that may be selected are stored first, and only their settings are put in order.
    Pass stored cleaned demographics as ``demo`` if something else reads them, too.
    """
    if demo is None:
        demo = visits.clean_demographics(
            visits.stay_demographics(base.icustays, base.admissions, base.patients), min_hours
        )
    path = new_table_path(demo.sparkSession, "first-adult-stays")
    eligible = replace_table(visits.first_adult_stays(demo), path)
    stays = eligible.select("icustay_id")
    episodes = ventilation_episodes(base.chartevents, base.procedures, gap_hours, stays)
    return visits.cohort_selection(eligible, episodes, base.services)


def study(
    base: BaseTables,
    min_hours: int = 27,
    window_and_lead: int = 27,
    lead: int = 3,
    selected: DataFrame | None = None,
) -> DataFrame:
    """Hourly vitals and labs of the cohort with its columns and comorbidity flags.

    The cohort is used three times; pass a stored one as ``selected`` to compute it once.
    """
    chosen = cohort(base, min_hours) if selected is None else selected
    events = visits.event_time_assignment(
        base.icustays, visits.event_users(chosen), window_and_lead
    )
    events = replace_table(events, new_table_path(events.sparkSession, "events"))
    hourly = measurements.hourly_vitals_labs(
        events, base.labevents, base.chartevents, window_and_lead, lead
    )
    # Flags are derived only for admissions that have a row to meet.
    admissions = base.admissions.join(chosen.select("hadm_id"), "hadm_id", "left_semi")
    flags = comorbidity.comorbidity_flags(base.diagnoses, admissions)
    return visits.study_table(hourly, chosen, flags)
