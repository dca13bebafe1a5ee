import numpy as np
import pytest

from tiltframe.llm import vectors


def plain(rows):
    """vec_id to (links, component) by all products."""
    good = [(i, np.array(v, float)) for i, v in rows]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, True)
    low = np.arange(len(good))
    ids = np.array([i for i, _ in good])
    low = ids.copy()
    while True:
        new = np.array([low[row].min() for row in linked])
        if (new == low).all():
            break
        low = new
    return {int(i): (int(n) - 1, int(c)) for i, n, c in zip(ids, linked.sum(1), low, strict=True)}


def found(df):
    rows = vectors.near_duplicates(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


@pytest.fixture(scope="module")
def families():
    rng = np.random.default_rng(3)
    rows = [rng.standard_normal(64) for _ in range(60)]
    for f in range(6):
        base = rng.standard_normal(64)
        rows += [base + rng.standard_normal(64) * s for s in np.linspace(0.02, 0.45, 25)]
    rows += [rows[70]] * 40
    return [(int(i), [float(np.float32(x)) for x in rows[k]]) for k, i in enumerate(rng.permutation(len(rows)))]


@pytest.mark.parametrize("cell", [512, 8])
def test_families_and_copies(spark, families, cell, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", cell)
    df = spark.createDataFrame(families, "vec_id long, embedding array<float>")
    want, got = plain(families), found(df)
    # A pair of cosine just over 0.9 may share no filter, once in about 1,500 times.
    assert sum(got[i] != want[i] for i in want) <= 2
    assert all(got[i][0] <= want[i][0] for i in want)


def test_vectors_that_link_with_nothing(spark):
    one = [1.0] * 8
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0] * 8), (4, [nan] + one[1:]), (5, [inf] + one[1:]), (6, [None] + one[1:]),
        (7, one), (9, one), (8, [2.0] * 8), (10, [1.0, 1.0]), (None, one), (11, [-1.0] * 8), (12, [-0.0] * 7 + [1.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, rep string, cell int")
    got = found(df)
    assert got == {
        **{i: (0, i) for i in (1, 2, 3, 4, 5, 6, 10, 11, 12)}, 7: (2, 7), 8: (2, 7), 9: (2, 7),
    }
    assert found(df.limit(0)) == {}


@pytest.mark.parametrize(("dim", "n"), [(3, 50), (8, 300), (24, 600), (64, 1000), (300, 400)])
def test_recall_at_the_threshold(dim, n):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    least = vectors.least_product(dim, 0.9)
    a = set(map(tuple, np.stack(vectors.decode(x, least), 1).tolist()))
    b = set(map(tuple, np.stack(vectors.decode(0.9 * x + np.sqrt(1 - 0.81) * y, least), 1).tolist()))
    assert len({owner for owner, _ in a & b}) >= 0.99 * len(x)


def test_decoding_finds_every_filter():
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((20, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = set(map(tuple, np.stack(vectors.decode(unit, 0.5), 1).tolist()))
    want = set()
    for c, (rotation, (one, two)) in enumerate(vectors.codes(16)):
        turned = unit @ rotation
        sums = (turned[:, :8] @ one.T)[:, :, None] + (turned[:, 8:] @ two.T)[:, None, :]
        for owner, a, b in np.argwhere(sums >= 0.5):
            want.add((owner, (c * vectors.WORDS + a) * vectors.WORDS + b))
    assert got == want


def test_other_lengths_and_extreme_components(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 1.0]) for i in (1, 2)] + [(3, [1.0, 1.05]), (4, [1.0, -1.0])]
    rows += [(10 + i, rng.standard_normal(8).tolist()) for i in range(30)]
    rows += [(50, [1e-200, 2e-200, 0.0]), (51, [2e-200, 4e-200, 1e-210]), (52, [1e300, 2e300, 0.0]), (53, [5e-324] * 3)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [got[i] for i in (1, 2, 3, 4)] == [(2, 1), (2, 1), (2, 1), (0, 4)]
    assert [got[i] for i in (50, 51, 52, 53)] == [(2, 50), (2, 50), (2, 50), (0, 53)]
    assert {i: got[i] for i in range(10, 40)} == plain(rows[4:34])
