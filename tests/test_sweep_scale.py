"""The sweep and the panel's operators at scale: compiled cells, cheap rounding, small files."""

import gzip
import math
import os
import zlib

from pyspark.sql import functions as F

from tiltframe.operators import effects as fx
from tiltframe.operators import ranking
from tiltframe.operators.scorers import ColumnScorer
from tiltframe.sources.delimited import write_sweep_csv
from workload.queries import _half_up

PLAN = [fx.Perturbation("a"), fx.Perturbation("b"), fx.Perturbation("c", 0.0, 1.0)]
NAMES = ["a", "b", "c"]
MODELS = {
    "m": ColumnScorer(lambda v: 1.0 / (1.0 + F.exp(-(0.5 * v["a"] - v["b"] + 0.3 * v["c"])))),
    "s": ColumnScorer(lambda v: F.when(v["a"] > 0, 0.7).otherwise(0.4)),
}


def _rows(spark):
    data = [(1, 0, 1.0, -2.0, 1.0), (2, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (3, 0, None, 2.0, 1.0), (None, 1, -1.0, float("nan"), 0.0)]
    return spark.createDataFrame(data, "case long, timepoint int, a double, b double, c double")


def _untold(df):
    """The same panel without what its column tells, for the general form of the operators."""
    return df.withColumn("panel", F.filter("panel", lambda m: F.lit(True)))


def _same(left, right):
    assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sweep_is_compiled_and_the_same(spark):
    rows = _rows(spark)
    got = fx.perturbation_sweep(rows, PLAN, MODELS, [None, 0.5])
    general = _untold(fx.static_effects(rows, PLAN, MODELS, [None, 0.5]))
    _same(got, fx.effects_long(fx.normalize_effects(general)))
    assert "lambda" not in _plan(got)


def test_named_cells_are_compiled_and_the_same(spark):
    panel = fx.static_effects(_rows(spark), PLAN, MODELS, [None, 0.5])
    assert fx.panel_layout(panel) == (["m", "s"], NAMES) and fx.panel_layout(_untold(panel)) is None
    for some in (None, ["a", "c"]):
        got = fx.normalize_effects(panel, some)
        assert "lambda" not in _plan(got)
        _same(got, fx.normalize_effects(_untold(panel), some))
        for rank in (1, 2, 5):
            ranks = ranking.rank_effects(got, rank)
            assert "lambda" not in _plan(ranks)
            _same(ranks, ranking.rank_effects(_untold(got), rank))
    _same(ranking.rank_effects(got, 2, ["s"]), ranking.rank_effects(_untold(got), 2, ["s"]))


def test_sweep_files_are_compressed_and_not_sorted(spark, tmp_path):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    write_sweep_csv(fx.perturbation_sweep(_rows(spark), PLAN, MODELS, [None, 0.5]), str(tmp_path / "out"))
    files = [f for _, _, names in os.walk(tmp_path / "out") for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert spark.conf.get(key) == before


def test_sweep_files_are_packed_at_the_quickest_level(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(4000, numPartitions=1).select(
        n.alias("case"), F.lit(0).alias("timepoint"), F.sin(n).alias("a"), F.cos(n).alias("b"), (n % 2).cast("double").alias("c")
    )
    sweep = fx.perturbation_sweep(rows, PLAN, MODELS, [None, 0.5])
    write_sweep_csv(sweep, str(tmp_path / "out"))
    files = [os.path.join(at, f) for at, _, names in os.walk(tmp_path / "out") for f in names if f.endswith(".csv.gz")]
    lines = 0
    for path in files:
        packed = open(path, "rb").read()
        text = gzip.decompress(packed)
        lines += text.count(b"\n") - 1
        quick, usual = (len(zlib.compress(text, level)) for level in (1, 6))
        assert abs(len(packed) - quick) < abs(len(packed) - usual)
    assert lines == sweep.count()


def test_rounding_is_that_of_spark(spark):
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -0.5e-6, 0.1234565, 1.0000005, -1.2345675, 1e-9, -1e-9, 123456.7890125]
    values += [1e17 / 3, 1e300, math.inf, -math.inf, math.nan, None, *(math.sin(i) * 10 ** (i % 9) for i in range(500))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (3, 4, 6):
        _same(df.select(_half_up(F.col("x"), digits).alias("x")), df.select(F.round("x", digits).alias("x")))
