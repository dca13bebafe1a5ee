"""Missing values, scaling, two-valued columns and class weights."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnStats:
    """Moments of one column; ``std`` is the population deviation, 1 for a constant column."""

    mean: float | None
    std: float | None
    low: float | None
    high: float | None


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    """One aggregate pass; a single row of numbers comes back."""
    parts = []
    for i, c in enumerate(columns):
        parts += [
            F.avg(c).alias(f"m{i}"),
            F.stddev_pop(c).alias(f"s{i}"),
            F.min(c).cast("double").alias(f"l{i}"),
            F.max(c).cast("double").alias(f"h{i}"),
        ]
    row = df.agg(*parts).first()
    out = {}
    for i, c in enumerate(columns):
        std = row[f"s{i}"]
        out[c] = ColumnStats(row[f"m{i}"], 1.0 if std == 0.0 else std, row[f"l{i}"], row[f"h{i}"])
    return out


def impute(
    df: DataFrame,
    mean_columns: Sequence[str],
    zero_columns: Sequence[str] = (),
    stats_from: DataFrame | None = None,
) -> DataFrame:
    """Null becomes the column mean (of this frame, or of ``stats_from``) or zero."""
    out = df
    if mean_columns:
        stats = column_stats(df if stats_from is None else stats_from, mean_columns)
        out = out.withColumns(
            {
                c: F.coalesce(F.col(c).cast("double"), F.lit(stats[c].mean).cast("double"))
                for c in mean_columns
            }
        )
    return out.fillna(0, subset=list(zero_columns)) if zero_columns else out


def zero_as_missing(df: DataFrame, columns: Sequence[str], exempt: Iterable[str] = ()) -> DataFrame:
    """Zero means missing except in ``exempt`` columns."""
    exempt = set(exempt)
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns if c not in exempt})


def impute_zero_as_missing(
    df: DataFrame,
    columns: Sequence[str],
    exempt: Iterable[str] = ("Outcome", "Pregnancies"),
    stats_from: DataFrame | None = None,
) -> DataFrame:
    chosen = [c for c in columns if c not in set(exempt)]
    source = None if stats_from is None else zero_as_missing(stats_from, chosen)
    return impute(zero_as_missing(df, chosen), chosen, stats_from=source)


@dataclass(frozen=True)
class Scaler:
    """Standardization fitted on one frame and applied to any other."""

    stats: dict[str, ColumnStats]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        return cls(column_stats(df, columns))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(s.mean)) / F.lit(s.std) for c, s in self.stats.items()}
        )

    def original(self, column: str, value: Column | None = None) -> Column:
        """A scaled value in original units."""
        s = self.stats[column]
        return (F.col(column) if value is None else value) * F.lit(s.std) + F.lit(s.mean)

    def inverse(self, df: DataFrame, digits: int | None = 3) -> DataFrame:
        """Back to original units, rounded for reports."""
        values = {c: self.original(c) for c in self.stats}
        if digits is not None:
            values = {c: F.round(v, digits) for c, v in values.items()}
        return df.withColumns(values)


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, low, high, is_binary (at most two distinct values), is_zero_one.

    Two plain aggregates instead of a distinct count per column: first the extremes, then
    whether any value lies strictly between them.
    """
    stats = column_stats(df, columns)
    checks = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        ends = value.isin([stats[c].low, stats[c].high]) if stats[c].low is not None else F.lit(True)
        checks.append(F.coalesce(F.bool_and(ends), F.lit(True)).alias(f"b{i}"))
        checks.append(F.coalesce(F.bool_and(value.isin([0.0, 1.0])), F.lit(True)).alias(f"z{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(stats[c].low).cast("double").alias("low"),
                F.lit(stats[c].high).cast("double").alias("high"),
                F.col(f"b{i}").cast("int").alias("is_binary"),
                F.col(f"z{i}").cast("int").alias("is_zero_one"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*checks).select(F.inline_outer(rows))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * count), one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")).first()
    return counts.select(
        label,
        "n",
        (F.lit(float(whole["rows"] or 0)) / (F.lit(float(whole["classes"])) * F.col("n"))).alias(
            "weight"
        ),
    )
