"""Queries that SQL can express, against DuckDB on whole tables; and the registration of all."""

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from tiltframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(repr, found.fetchall()))


def test_every_operator_is_registered():
    names = entry_points.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing",
    ]
