import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tiltframe.functions.overlap import (
    average_overlap,
    rank_biased_overlap,
    rank_biased_overlap_uneven,
    top_weight,
)


def by_depth(s, t, p, k=None, ext=False):
    """Agreement depth by depth, straight from the definition."""
    if not s and not t:
        return 1.0
    if not s or not t:
        return 0.0
    k = min(len(s), len(t), k or 10**9)
    agree = [len(set(s[:d]) & set(t[:d])) / d for d in range(1, k + 1)]
    if p == 1:
        return sum(agree) / k
    total = sum((1 - p) * p ** (d - 1) * a for d, a in enumerate(agree, 1))
    return min(1.0, total + (agree[-1] * p**k if ext else 0.0))


def uneven_by_depth(s, t, p):
    if not s and not t:
        return 1.0
    if not s or not t:
        return 0.0
    short, long = sorted((s, t), key=len)
    n, m = len(short), len(long)
    x = [0] + [len(set(short[:d]) & set(long[:d])) for d in range(1, m + 1)]
    seen = sum((1 - p) * p ** (d - 1) * x[d] / d for d in range(1, m + 1))
    unseen = sum((1 - p) * p ** (d - 1) * x[n] * (d - n) / (n * d) for d in range(n + 1, m + 1))
    return min(1.0, seen + unseen + ((x[m] - x[n]) / m + x[n] / n) * p**m)


def lists(spark, rows):
    return spark.createDataFrame(rows, "s array<int>, t array<int>")


def test_documented_values(spark):
    df = lists(spark, [([1, 2, 3], [1, 3, 2]), ([1, 3, 2], [1, 3, 2, 4, 5, 6]), ([1, 2, 3, 4, 5], [5, 4, 3, 2, 1])])
    got = [r[0] for r in df.select(average_overlap(F.col("s"), F.col("t"))).collect()]
    assert got == pytest.approx([0.8333333333333334, 1.0, 0.41667], abs=1e-5)


def test_random_lists_match_the_definition(spark):
    rng = random.Random(3)
    rows = [
        (rng.sample(range(12), rng.randint(0, 9)), rng.sample(range(12), rng.randint(0, 9)))
        for _ in range(300)
    ]
    s, t = F.col("s"), F.col("t")
    got = lists(spark, rows).select(
        rank_biased_overlap(s, t, p=0.9),
        rank_biased_overlap(s, t, p=0.9, k=3),
        rank_biased_overlap(s, t, p=0.9, ext=True),
        rank_biased_overlap(s, t, p=1.0),
        rank_biased_overlap_uneven(s, t, p=0.98),
        rank_biased_overlap(t, s, p=0.9),
    ).collect()
    for (a, b), r in zip(rows, got):
        assert r[0] == pytest.approx(by_depth(a, b, 0.9), abs=1e-12)
        assert r[1] == pytest.approx(by_depth(a, b, 0.9, k=3), abs=1e-12)
        assert r[2] == pytest.approx(by_depth(a, b, 0.9, ext=True), abs=1e-12)
        assert r[3] == pytest.approx(by_depth(a, b, 1), abs=1e-12)
        assert r[4] == pytest.approx(uneven_by_depth(a, b, 0.98), abs=1e-12)
        assert r[5] == pytest.approx(r[0], abs=1e-15) and 0.0 <= r[0] <= 1.0


def test_top_weight(spark):
    df = spark.createDataFrame([(0.9, 10), (0.98, 50), (0.9, 0), (0.9, 1)], "p double, d int")
    got = [r[0] for r in df.select(top_weight(F.col("p"), F.col("d"))).collect()]
    assert got == pytest.approx([0.85559, 0.85223, 1.0, 0.1 / 0.9 * math.log(10)], abs=1e-5)


def test_repeated_items_fail(spark):
    s, t = F.col("s"), F.col("t")
    with pytest.raises(PySparkException):
        lists(spark, [([1, 1], [1, 2])]).select(rank_biased_overlap(s, t)).collect()
    with pytest.raises(ValueError):
        rank_biased_overlap(s, t, p=1.5)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_long_lists_and_null_lists(spark, ansi):
    rng = random.Random(5)
    s, t = rng.sample(range(700), 500), rng.sample(range(700), 450)
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(s, t), (s, s), (None, t), (s, None)], "s array<int>, t array<int>")
        a, b = F.col("s"), F.col("t")
        got = df.select(
            rank_biased_overlap(a, b, p=0.9), average_overlap(a, b), rank_biased_overlap(a, b, 0.995, ext=True),
            rank_biased_overlap_uneven(a, b, 0.995),
        ).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    want = (by_depth(s, t, 0.9), by_depth(s, t, 1), by_depth(s, t, 0.995, ext=True), uneven_by_depth(s, t, 0.995))
    assert tuple(got[0]) == pytest.approx(want)
    assert got[1][1] == pytest.approx(1.0)
    assert tuple(got[2]) == tuple(got[3]) == (None,) * 4
