"""Every model under every perturbation size, written as partitioned CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tiltframe.operators.effects import (
    Perturbation,
    effects_long,
    normalize_effects,
    perturbation_sweep,
    series_effects,
)
from tiltframe.operators.scorers import Scorer
from tiltframe.sources.delimited import write_sweep_csv

SIZES = (None, 0.5, 0.7, 0.9)


def run_sweep(
    rows: DataFrame,
    plan: Sequence[Perturbation],
    scorers: dict[str, Scorer],
    path: str,
    series_scorers: dict | None = None,
    length: int | None = None,
    baselines: Sequence[float | None] = SIZES,
) -> None:
    """One job for all (model, size) pairs; sequence models join the same output."""
    out = perturbation_sweep(rows, plan, scorers, baselines)
    if series_scorers:
        series = series_effects(rows, plan, series_scorers, length, baselines)
        out = out.unionByName(effects_long(normalize_effects(series)))
    write_sweep_csv(out, path)
