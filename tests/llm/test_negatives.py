import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltframe.llm import integers, negatives

KINDS = "vec_id long, embedding array<double>, label int, row long, block string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "b", 2) for i, v, label in rows], KINDS)


def plain(rows, scale=256, k=5, least=80):
    """The result by all products in Python's integers."""
    good = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((n, i, [max(-(2**63), min(2**63, int(np.floor(np.clip(x * scale, -1e300, 1e300))))) for x in v], label))
    out = []
    for n, i, v, label in good:
        if i % 100:
            continue
        scored = []
        for m, j, w, other in good:
            if m != n and len(w) == len(v):
                s = sum(a * b for a, b in zip(v, w, strict=True))
                scored.append((-max(-(2**63), min(2**63 - 1, s)), j, m, other == label))
        scored.sort()
        for s, j, _, _ in [x for x in scored if x[3]][:k]:
            fits = [x for x in scored if not x[3] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def found(df, **more):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()))


@pytest.mark.parametrize("size", [1, 30, 1000, 10**7, 2**40, 2**63])
def test_exact_products(size):
    rng = np.random.default_rng(2)
    a, b = (np.floor(rng.uniform(-size, size, (n, 70))) for n in (9, 11))
    a[0], b[0], b[1] = size, size, -size
    want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
    assert negatives.scores(a, b).tolist() == want


def test_float32_is_exact_within_a_slice():
    assert negatives.SLICE * (max(negatives.primes()) // 2) ** 2 < 1 << 24


@pytest.mark.parametrize(("least", "searchers"), [(1024, 8192), (7, 2)])
def test_against_all_products(spark, monkeypatch, least, searchers):
    monkeypatch.setattr(integers, "LEAST_BLOCK", least)
    monkeypatch.setattr(integers, "SEARCHERS", searchers)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 8))
    rows = []
    for n in range(400):
        # A third of the rows have one label, and many are copies.
        v = base[n % 6] + (0 if n % 5 == 0 else 0.3) * rng.standard_normal(8)
        rows.append((25 * n, v.tolist(), 1 if n % 3 == 0 else n % 4))
    want = plain(rows)
    assert len(want) > 200
    assert found(frame(spark, rows)) == want


def test_edges(spark):
    nan, one = float("nan"), [1.0, 2.0]
    rows = [
        (0, one, 1), (1, one, 1), (2, one, 2), (3, [0.9, 2.0], 2), (4, None, 1), (5, [1.0, None], 2), (6, [nan, 1.0], 2), (7, one, None),
        (None, one, 2), (8, [1.0], 2), (9, [], 2), (100, [], 1), (200, [1.0], 1), (300, one, 2), (300, one, 2), (10, [1e306, 1.0], 2),
        (400, [-1.0, -1.0], 3), (11, [-1.0, -1.0], 3), (12, [float("inf"), 0.0], 1), (500, [1e307, 1.0], 4), (13, [1e300, 1.0], 4),
    ]
    assert found(frame(spark, rows)) == plain(rows)
    assert found(frame(spark, rows).limit(0)) == []
    assert found(frame(spark, [r for r in rows if r[0] != 0 and (r[0] or 1) % 100])) == []
