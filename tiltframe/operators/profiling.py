"""Distributions, histograms, correlations and frequency tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.functions.scalar import literal_array
from tiltframe.functions.sums import matrix_sums
from tiltframe.operators.scaling import column_stats


def distribution_fit(df: DataFrame, features: Sequence[str], points: int = 100) -> DataFrame:
    """Mean, population variance and a ``points``-point Gaussian curve over [min, max]."""
    moments = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.avg(f).alias("mean"),
                    F.var_pop(f).alias("variance"),
                    F.min(f).cast("double").alias("low"),
                    F.max(f).cast("double").alias("high"),
                )
                for f in features
            ]
        ).alias("s")
    ).select(F.inline_outer("s"))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / F.lit(float(points - 1))
    density = F.exp(-0.5 * F.pow(F.col("x") - F.col("mean"), 2) / F.col("variance")) / F.sqrt(
        2.0 * math.pi * F.col("variance")
    )
    return (
        moments.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .select("feature", "mean", "variance", "point", "x", density.alias("density"))
    )


def histogram_density(
    df: DataFrame, features: Sequence[str], bins: int = 30, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width density histogram of every feature (per group), last bin closed.

    All features are counted in one pass; empty bins are listed with density 0.
    """
    keys = list(by)
    if not by:
        # Without groups the edges are one row of numbers and enter the plan as constants.
        stats, n = column_stats(df, features), df.agg(*[F.count(f) for f in features]).first()
        constant = F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.lit(stats[f].low).cast("double").alias("low"),
                    F.lit(stats[f].high).cast("double").alias("high"),
                    F.lit(n[i]).alias("n"),
                )
                for i, f in enumerate(features)
            ]
        )
        edges = df.sparkSession.range(1).select(constant.alias("edges"))
        joined = df.withColumn("edges", constant)
    else:
        edges = df.groupBy(*by).agg(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.min(f).cast("double").alias("low"),
                        F.max(f).cast("double").alias("high"),
                        F.count(f).alias("n"),
                    )
                    for f in features
                ]
            ).alias("edges")
        )
        joined = df.join(edges, keys)
    values = F.array(*[F.col(f).cast("double") for f in features])
    cells = F.transform(
        F.arrays_zip(values.alias("value"), F.col("edges").alias("edge")),
        lambda c: F.struct(
            c["edge"]["feature"].alias("feature"),
            F.least(
                F.floor(
                    F.try_divide(
                        (c["value"] - c["edge"]["low"]) * bins, c["edge"]["high"] - c["edge"]["low"]
                    )
                ),
                F.lit(bins - 1),
            )
            .cast("int")
            .alias("bin"),
        ),
    )
    counted = (
        joined.select(*by, F.inline_outer(cells))
        .where(F.col("bin").isNotNull())
        .groupBy(*by, "feature", "bin")
        .agg(F.count("*").alias("count"))
    )
    every = edges.select(*by, F.inline_outer("edges")).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    width = (F.col("high") - F.col("low")) / bins
    return every.join(counted, [*by, "feature", "bin"], "left").select(
        *by,
        "feature",
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(F.try_divide(F.col("count"), F.col("n") * width), F.lit(0.0)).alias("density"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson's correlation of every pair of columns over the rows that have both (null and NaN count as
    missing); NaN where one of them does not vary there.

    Two passes of fixed plan size, whatever the number of pairs: the means, then one sum of matrices
    (counts, sums, squares and products of pairs) of the values less their means.
    """
    present = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(present)])
    facts = rows.agg(F.array(*[F.avg(c) for c in rows.columns]), F.array(*[F.max(F.abs(c)) for c in rows.columns])).first()
    means, largest = (np.array([0.0 if v is None else v for v in part]) for part in facts)

    def part(block: np.ndarray) -> np.ndarray:
        have = (~np.isnan(block)).astype(np.float64)
        x = np.nan_to_num(block - means)
        return np.stack((have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x))

    n, own, squares, products = matrix_sums(rows, rows.columns, part)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - own * own / n
        spread[spread <= n * (1e-13 * largest[:, None]) ** 2] = np.nan
        return (products - own * own.T / n) / np.sqrt(spread * spread.T)


def top_abs_correlations(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The n largest absolute pairwise correlations."""
    found = np.abs(correlations(df, columns))
    pairs = [(a, b, float(found[i, j])) for (i, a), (j, b) in combinations(enumerate(columns), 2) if not np.isnan(found[i, j])]
    pairs.sort(key=lambda p: (-p[2], p[0], p[1]))
    kinds = "column_a string, column_b string, corr double"
    return df.sparkSession.createDataFrame(pairs[:n], kinds)


def effects_with_features(
    wide: DataFrame, data: DataFrame, model: str, features: Sequence[str], label: str = "label"
) -> DataFrame:
    """Coefficient columns of one model next to the features and the label."""
    coefficients = wide.select("case", "timepoint", *[f"{model}_{f}" for f in features])
    return coefficients.join(data.select("case", "timepoint", *features, label), ["case", "timepoint"])


def frequency_table(df: DataFrame, columns: Sequence[str], with_null: bool = True) -> DataFrame:
    """Value counts of several columns in one scan: (column, value, n)."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    rows = df.select(F.inline_outer(cells))
    if not with_null:
        rows = rows.where(F.col("value").isNotNull())
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"))


def cohort_profile(frames: dict[str, tuple[DataFrame, Sequence[str]]], subject: str) -> DataFrame:
    """Frequency tables, row counts and distinct subjects of several frames as one table
    (frame, column, value, n)."""
    parts = []
    for name, (df, columns) in frames.items():
        # Two-step distinct count: unique subjects are found first, then counted.
        people = df.select(subject).where(F.col(subject).isNotNull()).distinct()
        facts = [
            frequency_table(df, columns),
            df.agg(F.count("*").alias("n")).select(
                F.lit("(rows)").alias("column"), F.lit(None).cast("string").alias("value"), "n"
            ),
            people.agg(F.count("*").alias("n")).select(
                F.lit("(subjects)").alias("column"), F.lit(None).cast("string").alias("value"), "n"
            ),
        ]
        parts += [f.withColumn("frame", F.lit(name)) for f in facts]
    return reduce(DataFrame.unionByName, parts).select("frame", "column", "value", "n")
