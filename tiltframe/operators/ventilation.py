"""Ventilation episodes: sessionizing charted settings by gaps, extubation and oxygen start."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltframe import codes
from tiltframe.functions.chunked import row_positions
from tiltframe.functions.scalar import elapsed_hours, hours

# A stay may be null (settings charted outside a stay form one group); two plain columns keep
# joins and windows on it null-safe.
_KEYS = ["__no_stay", "__stay"]
_DAY = "__day"
# At equal times a ventilation row comes before an extubation row.
_ORDER = ["charttime", "extubated", "mechvent", "oxygentherapy", "selfextubated"]


def _any(conditions: list[Column]) -> Column:
    return F.when(reduce(lambda a, b: a | b, conditions), 1).otherwise(0)


def _charted_and_performed(chartevents: DataFrame, procedures: DataFrame) -> DataFrame:
    item, value = F.col("itemid"), F.col("value")
    setting_items = [
        *codes.VENT_SETTING_ITEMS,
        *codes.VENT_TYPE_ITEMS,
        codes.VENT_MODE_ITEM,
        codes.EXTUBATION_ITEM,
        *codes.OXYGEN_TEXTS,
        *codes.OXYGEN_FLOW_ITEMS,
    ]
    ventilated = [(item == i) & (value != text) for i, text in codes.VENT_TYPE_ITEMS.items()]
    ventilated += [
        item == codes.VENT_MODE_ITEM,
        (item == codes.OXYGEN_DEVICE_ITEM) & (value == codes.OXYGEN_DEVICE_VENT),
        item.isin(codes.VENT_SETTING_ITEMS),
    ]
    oxygen = [(item == i) & value.isin(texts) for i, texts in codes.OXYGEN_TEXTS.items()]
    out = [(item == codes.EXTUBATION_ITEM) & value.isin(codes.EXTUBATION_TEXTS)]
    self_out = [(item == codes.EXTUBATION_ITEM) & (value == codes.SELF_EXTUBATION_TEXT)]
    charted = (
        chartevents.where(
            value.isNotNull() & ~F.col("error").eqNullSafe(1) & item.isin(setting_items)
        )
        .groupBy("icustay_id", "charttime")
        .agg(
            F.max(_any(ventilated)).alias("mechvent"),
            F.max(_any(oxygen)).alias("oxygentherapy"),
            F.max(_any(out)).alias("extubated"),
            F.max(_any(self_out)).alias("selfextubated"),
        )
    )
    performed = procedures.where(item.isin(codes.EXTUBATION_PROCEDURES)).select(
        "icustay_id",
        F.col("starttime").alias("charttime"),
        F.lit(0).alias("mechvent"),
        F.lit(0).alias("oxygentherapy"),
        F.lit(1).alias("extubated"),
        F.when(item == codes.SELF_EXTUBATION_PROCEDURE, 1).otherwise(0).alias("selfextubated"),
    )
    return charted.unionByName(performed)


def vent_settings(chartevents: DataFrame, procedures: DataFrame) -> DataFrame:
    """0/1 mechvent, oxygentherapy, extubated and selfextubated per (stay, time); extubation
    procedures are rows of their own."""
    return _charted_and_performed(chartevents, procedures).distinct()


def mark_episodes(settings: DataFrame, gap_hours: int = 8) -> DataFrame:
    """Add newvent and the running episode number ventnum to the settings; repeated rows count once.

    A row starts an episode when the previous ventilation-or-extubation row was an extubation,
    when oxygen is given without ventilation, or when ventilation resumes after more than
    ``gap_hours``. All three look at the past of the stay, which is cut into calendar days.

    A day is summed up as a state: its last mark, its last ventilation, the starts that its own rows
    decide, and the two rows that look further back, its first mark and its first ventilation. One
    window over the days of a stay resolves these two and counts the starts before each day; the rows
    meet their day again where they were, as both sides are dealt out by day.
    """
    vent, ext = F.col("mechvent") == 1, F.col("extubated") == 1
    gap = hours(gap_hours)
    day = [*_KEYS, _DAY]
    rows = settings.withColumns(
        {
            "__no_stay": F.col("icustay_id").isNull(),
            "__stay": F.coalesce("icustay_id", F.lit(0)),
            _DAY: F.coalesce(F.to_date("charttime"), F.lit("9999-12-31").cast("date")),
        }
    )
    # Dealt out by day, equal rows meet without another shuffle.
    rows = rows.repartition(*day).distinct()
    before = Window.partitionBy(*day).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "__vent_time": F.when(vent, F.col("charttime")),
            "__out_mark": F.when(vent | ext, F.struct("charttime", F.col("extubated").alias("out"))),
        }
    )
    rows = rows.withColumns(
        {
            "__day_vent": F.max("__vent_time").over(before),
            "__day_mark": F.last("__out_mark", ignorenulls=True).over(before),
        }
    )

    def starts(last_out: Column, last_vent: Column) -> Column:
        return (
            F.when((vent | ext) & (last_out == 1), 1)
            # Rows that are neither look back along their own kind, where nothing is an extubation.
            .when(~vent & (F.col("oxygentherapy") == 1), 1)
            .when(vent & (F.col("charttime") - last_vent > gap), 1)
            .otherwise(0)
        )

    rows = rows.withColumn("__own", starts(F.col("__day_mark")["out"], F.col("__day_vent")))
    first_mark = (vent | ext) & F.col("__day_mark").isNull()
    first_vent = vent & F.col("__day_vent").isNull()
    days = rows.groupBy(*day).agg(
        F.sum("__own").alias("starts"),
        F.max("__out_mark").alias("mark"),
        F.max("__vent_time").alias("vent"),
        F.max(F.when(first_mark & (F.col("__own") == 0), 1)).alias("mark_open"),
        F.max(F.when(first_vent & (F.col("__own") == 0), F.struct("charttime", first_mark.alias("is_mark")))).alias("vent_open"),
    )
    earlier = Window.partitionBy(*_KEYS).orderBy(_DAY).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"__past_out": F.max("mark").over(earlier)["out"], "__past_vent": F.max("vent").over(earlier)})
    at_mark = (F.col("mark_open") == 1) & (F.col("__past_out") == 1)
    at_vent = F.col("vent_open")["charttime"] - F.col("__past_vent") > gap
    # One row may be both, and starts one episode then.
    more = F.when(at_mark, 1).otherwise(0) + F.when(at_vent & ~(F.coalesce(at_mark, F.lit(False)) & F.col("vent_open")["is_mark"]), 1).otherwise(0)
    days = days.withColumn("__starts", F.col("starts") + more)
    days = days.withColumn("__before", F.coalesce(F.sum("__starts").over(earlier), F.lit(0)))
    rows = rows.join(days.select(*day, "__past_out", "__past_vent", "__before"), day)
    last_out = F.coalesce(F.col("__day_mark")["out"], F.col("__past_out"))
    rows = rows.withColumn("newvent", starts(last_out, F.coalesce("__day_vent", "__past_vent")))
    so_far = Window.partitionBy(*day).orderBy("charttime").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.sum("newvent").over(so_far) + F.col("__before")
    rows = rows.withColumn("ventnum", F.when(vent | ext, number))
    return rows.select(*settings.columns, *_KEYS, _DAY, "newvent", "ventnum")


def ventilation_episodes(
    chartevents: DataFrame, procedures: DataFrame, gap_hours: int = 8, stays: DataFrame | None = None
) -> DataFrame:
    """icustay_id, ventnum (from 1 in time order), mv_start, mv_end, mv_hours; of the stays listed
    in ``stays`` if it is given.

    Episodes of a stay follow from its own rows alone. Settings of other stays are left out once they are
    one row per time, when little is left to shuffle, and before they are dealt out by day and sorted.
    """
    settings = _charted_and_performed(chartevents, procedures)
    if stays is not None:
        settings = settings.join(stays.select("icustay_id"), "icustay_id", "left_semi")
    marked = mark_episodes(settings, gap_hours)
    episodes = (
        marked.where(F.col("ventnum").isNotNull())
        .groupBy(*_KEYS, "ventnum")
        .agg(
            F.min("icustay_id").alias("icustay_id"),
            F.min("charttime").alias("mv_start"),
            F.max("charttime").alias("mv_end"),
            F.max("mechvent").alias("vented"),
        )
        .where((F.col("mv_start") != F.col("mv_end")) & (F.col("vented") == 1))
        .withColumn("__month", F.trunc(F.to_date("mv_start"), "month"))
    )
    numbered = row_positions(episodes, _KEYS, "__month", ["ventnum"], "__number")
    return numbered.select(
        "icustay_id",
        F.col("__number").cast("int").alias("ventnum"),
        "mv_start",
        "mv_end",
        elapsed_hours(F.col("mv_start"), F.col("mv_end")).alias("mv_hours"),
    )
