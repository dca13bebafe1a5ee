import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltframe.llm import integers, mtree

KINDS = "vec_id long, embedding array<double>, label int, row long, tree string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "t", 3) for i, v in rows], KINDS)


def plain(rows, scale=1024, k=10):
    good = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((n, i, [max(-(2**63), min(2**63, int(np.floor(np.clip(x * scale, -1e300, 1e300))))) for x in v]))
    out = []
    for n, i, v in good:
        if i % 100:
            continue
        scored = []
        for m, j, w in good:
            if m != n and len(w) == len(v):
                s = sum(a * b for a, b in zip(v, w, strict=True))
                scored.append((-max(-(2**63), min(2**63 - 1, s)), j))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df, **more):
    return sorted(map(tuple, mtree.top_k(df, F.col("vec_id") % 100 == 0, **more).collect()))


def clusters(seed, n, dim, spread=0.05):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, dim))
    return np.floor(1024 * (base[rng.integers(12, size=n)] * rng.uniform(0.5, 1.5, (n, 1)) + spread * rng.standard_normal((n, dim))))


@pytest.mark.parametrize("dim", [1, 2, 16, 64])
def test_one_tree(dim):
    x = clusters(dim, 3000, dim)
    x[500:1500] = x[500]
    pages, center, reach = mtree.build(x)
    assert all(len(v) <= mtree.PAGE for v in pages.vectors)
    places = np.sort(np.concatenate([b for b, leaf in zip(pages.below, pages.leaf, strict=True) if leaf]))
    assert places.tolist() == list(range(3000))
    ids = np.random.default_rng(0).permutation(3000)
    tree = mtree.Search(pages, ids, np.arange(3000), x[center], reach)
    queries = range(0, 3000, 60)
    for q in queries:
        scores, found_places = tree.best(x[q], q, 10)
        all_scores = (x @ x[q]).astype(np.int64)
        order = [p for p in np.lexsort((ids, -all_scores)) if p != q][:10]
        assert found_places.tolist() == order and scores.tolist() == all_scores[order].tolist()
        # Only what reaches a known score.
        known = int(scores[4])
        assert tree.best(x[q], q, 10, known)[0].tolist() == [s for s in scores.tolist() if s >= known]


def test_bounds_save_products():
    x = clusters(5, 8000, 16)
    x *= 1024 / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.floor(x)
    pages, center, reach = mtree.build(x)
    tree = mtree.Search(pages, np.arange(8000), np.arange(8000), x[center], reach)
    for q in range(0, 8000, 80):
        tree.best(x[q], q, 10)
    assert tree.products < 0.4 * 8000 * 100


@pytest.mark.parametrize(("least", "searchers", "roots"), [(1024, 8192, 1024), (20, 5, 3)])
def test_against_all_products(spark, monkeypatch, least, searchers, roots):
    monkeypatch.setattr(integers, "LEAST_BLOCK", least)
    monkeypatch.setattr(integers, "SEARCHERS", searchers)
    monkeypatch.setattr(mtree, "ROOTS", roots)
    x = clusters(3, 600, 8) / 1024
    x[100:300] = x[100]
    rows = [(10 * i, v.tolist()) for i, v in enumerate(x)]
    assert found(frame(spark, rows)) == plain(rows)


def test_edges(spark):
    nan, one = float("nan"), [1.0, 2.0]
    rows = [
        (0, one), (1, one), (2, [1.5, -2.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (None, one), (8, [1.0]), (9, []), (100, []),
        (200, [1.0]), (300, one), (300, one), (10, [1e306, 1.0]), (400, [0.0, 0.0]), (12, [float("inf"), 0.0]), (500, [1e307, -1e15]),
        (13, [4e9, 3e9]), (600, [3e9, -4e9]), (14, [0.0, 0.0, 0.0]), (700, [1.0, 2.0, 3.0, 4.0]),
    ]
    assert found(frame(spark, rows)) == plain(rows)
    assert found(frame(spark, rows).limit(0)) == []
    assert found(frame(spark, rows[1:4])) == []
