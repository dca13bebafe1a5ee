"""From panel time series to model-ready rows.

``timepoint`` counts hours (or days) before the event, so the last measurement of a case is the
one with the smallest timepoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltframe.functions.chunked import global_positions, with_carry
from tiltframe.functions.scalar import literal_array


def _known_at(feature: str, time: str) -> Column:
    return F.when(F.col(feature).isNotNull(), F.col(time))


def last_value(feature: str, time: str = "timepoint") -> Column:
    return F.min_by(F.col(feature), _known_at(feature, time))


def first_value(feature: str, time: str = "timepoint") -> Column:
    return F.max_by(F.col(feature), _known_at(feature, time))


def last_value_features(
    df: DataFrame,
    features: Sequence[str],
    outcome: str,
    case: str = "case",
    time: str = "timepoint",
    last: bool = True,
) -> DataFrame:
    """One row per case: last (or first) known value per feature; the label is the last row's.

    A plain aggregate with map-side combine: no window, no sort per case.
    """
    pick = last_value if last else first_value
    return df.groupBy(case).agg(
        *[pick(f, time).alias(f) for f in features],
        F.min_by(F.col(outcome), F.col(time)).cast("int").alias("label"),
    )


def first_last_features(
    df: DataFrame,
    both: Sequence[str],
    last_only: Sequence[str],
    outcome: str,
    case: str = "case",
    time: str = "timepoint",
) -> DataFrame:
    """first_x and last_x for the features in ``both``, the last value for the others."""
    return df.groupBy(case).agg(
        *[first_value(f, time).alias(f"first_{f}") for f in both],
        *[last_value(f, time).alias(f"last_{f}") for f in both],
        *[last_value(f, time).alias(f) for f in last_only],
        F.min_by(F.col(outcome), F.col(time)).cast("int").alias("label"),
    )


def forward_fill_series(
    df: DataFrame,
    features: Sequence[str],
    case: str = "case",
    time: str = "timepoint",
    chunk_steps: int = 1024,
) -> DataFrame:
    """Every row with, per feature, the last known value so far (larger timepoints are earlier).

    Long cases are filled in chunks of ``chunk_steps`` timepoints with the last value of the
    earlier chunks carried in.
    """
    parts = {
        f"__carry_{f}": (last_value(f, time), lambda c: F.last(c, ignorenulls=True))
        for f in features
    }
    chunk = -F.floor(F.col(time) / chunk_steps).cast("bigint")
    carried = with_carry(df.withColumn("__chunk", chunk), [case], "__chunk", parts)
    so_far = (
        Window.partitionBy(case, "__chunk")
        .orderBy(F.col(time).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = {
        f: F.coalesce(F.last(f, ignorenulls=True).over(so_far), F.col(f"__carry_{f}"))
        for f in features
    }
    return carried.withColumns(filled).drop("__chunk", *parts)


def series_length(df: DataFrame, time: str = "timepoint") -> int:
    """Number of distinct timepoints, the default sequence length."""
    return df.select(time).distinct().count()


def within_length(df: DataFrame, case: str, length: int) -> DataFrame:
    """With ``__within``, true in every row; a row of a case of more than ``length`` rows fails the query.

    The window that counts a case's rows spills to disk and holds no arrays, and what gathers the case
    afterwards needs no other shuffle.
    """
    counted = df.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(case)))
    within = F.when(
        F.col("__rows") > length, F.raise_error(F.lit(f"a case has more than {length} timepoints")).cast("boolean")
    ).otherwise(True)
    return counted.withColumn("__within", within).drop("__rows")


def sequence_pad(
    df: DataFrame,
    features: Sequence[str],
    length: int | None = None,
    label: str | None = None,
    case: str = "case",
    time: str = "timepoint",
) -> DataFrame:
    """One row per case with one zero-padded array per feature, earliest step first.

    A case with more steps than ``length`` fails the query before anything is gathered, so ``length``
    bounds each gather.
    """
    length = series_length(df, time) if length is None else length
    step = F.struct((-F.col(time)).alias("t"), *[F.col(f).cast("double").alias(f) for f in features])
    carried = [F.min_by(F.col(label), F.col(time)).alias("label")] if label else []
    rows = within_length(df.select(case, time, *features, *([label] if label else [])), case, length)
    steps = F.sort_array(F.collect_list(F.when(F.col("__within"), step)))
    padded = rows.groupBy(case).agg(steps.alias("__steps"), *carried)
    padding = F.array_repeat(F.lit(0.0), F.lit(length) - F.size("__steps"))
    return padded.select(
        case,
        *[F.concat(F.transform("__steps", lambda s: s[f]), padding).alias(f) for f in features],
        *(["label"] if label else []),
    )


def series_slice(
    df: DataFrame, at: int | Column, reverse: bool = True, time: str = "timepoint"
) -> DataFrame:
    """The history up to a timepoint."""
    return df.where(F.col(time) >= at if reverse else F.col(time) <= at)


def category_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, category, name): the distinct values of string columns, null as '', named
    column-category; other columns are listed once under their own name."""
    wanted = [f for f in df.schema if columns is None or f.name in columns]
    strings = [f.name for f in wanted if isinstance(f.dataType, T.StringType)]
    others = [f.name for f in wanted if f.name not in strings]
    out = None
    if strings:
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("category"))
                for c in strings
            ]
        )
        out = (
            df.select(F.inline_outer(cells))
            .distinct()
            .withColumn("name", F.format_string("%s-%s", F.col("column"), F.col("category")))
        )
    if others:
        plain = df.sparkSession.range(1).select(F.explode(literal_array(others)).alias("column"))
        plain = plain.select(
            "column", F.lit(None).cast("string").alias("category"), F.col("column").alias("name")
        )
        out = plain if out is None else out.unionByName(plain)
    return out


def case_keys(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Static rows under (case, timepoint): case counts from 0 in the order of a unique integer
    ``key``, timepoint is 0, features are sorted by name."""
    numbered = global_positions(df, key, "case")
    return numbered.select(
        F.col("case").cast("bigint").alias("case"),
        F.lit(0).alias("timepoint"),
        *sorted(features),
    )
