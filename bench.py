"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "model_panel",
    "perturbation_sweep",
    "consensus_winner",
    "rbo_summary",
    "evaluate_models",
    "standardize",
    "split_by_case",
    "forward_fill_series",
    "series_effects",
    "last_value_features",
    "ventilation_episodes",
    "comorbidity_flags",
    "first_day_labs",
    "first_day_vitals",
    "hourly_vitals_labs",
    "notes_before_event",
    "study_table",
]


def main() -> None:
    from tiltframe.session import local_session

    cores = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores, **{"spark.sql.shuffle.partitions": str(cores)})
    spark.sparkContext.setLogLevel("OFF")
    from workload.queries import QUERIES

    chosen = sys.argv[1:] or HEADLINE
    QUERIES["last_value_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
