import time

import numpy as np
import pytest

from tiltframe.llm import periodic, queries


def plain(w):
    """start, length, period of all runs, period by period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def found(texts):
    lengths = np.array([len(t) for t in texts], np.int64)
    text, *rest = periodic.find_runs(np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64), lengths)
    out = [[] for _ in texts]
    for t, *run in zip(text.tolist(), *(c.tolist() for c in rest), strict=True):
        out[t].append(tuple(run))
    return out


def test_cover():
    assert {(a - b) % periodic.COVER for a in periodic.SAMPLED for b in periodic.SAMPLED} == set(range(periodic.COVER))
    at = np.arange(periodic.COVER)
    for side in (at[:, None], at[None, :]):
        assert np.isin((side + periodic.shifts()) % periodic.COVER, periodic.SAMPLED).all()


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(60):
        n, p = int(rng.integers(0, 400)), int(rng.integers(1, 60))
        kinds = [
            rng.integers(1, 3, n),
            np.resize(rng.integers(1, 4, p), n),
            np.concatenate((rng.integers(1, 4, n // 3), np.resize(rng.integers(1, 9, p), n), rng.integers(1, 4, n // 3))),
            np.concatenate((np.resize(rng.integers(1, 3, p), n), np.resize(rng.integers(1, 3, p), n))),
        ]
        texts.append(kinds[rng.integers(4)])
    assert found(texts) == [plain(t.tolist()) for t in texts]


def test_common_extensions():
    words = np.concatenate((np.resize(np.random.default_rng(1).integers(1, 3, 37), 700), [5]))
    extensions = periodic.Extensions(words)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(0, 701, 7), np.arange(701)))
    i, j = i[i != j], j[i != j]
    want = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        n = 0
        while max(a, b) + n < 701 and words[a + n] == words[b + n]:
            n += 1
        want.append(n)
    assert extensions.common(i, j).tolist() == want


def test_long_texts():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    word = np.frombuffer(fibonacci[-1].encode(), np.uint8) - 96
    # A Fibonacci word holds no fourth power.
    assert found([word]) == [[]]
    began = time.perf_counter()
    same, cycle = np.ones(100_000, np.int64), np.resize(np.arange(1, 25_000), 100_000)
    assert found([same, cycle]) == [[(0, 100_000, 1)], [(0, 100_000, 24_999)]]
    assert time.perf_counter() - began < 30


def test_documents(spark, frame):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (5, "a a a a a"), (6, "x Ab\x0bAb Ab\nAb Ab Ab y"), (7, "a b " * 4),
        (8, "a b a b a b a c"), (9, "Word word " * 3), (None, "z " * 7), (4, "a " * 6), (10, "  " * 8), (11, "a b c " * 9 + "d " * 8),
    ]
    docs = frame(rows).withColumnRenamed("root", "runs").withColumnRenamed("prefix", "n_words")
    got = periodic.with_runs(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "lost", "n_words", "runs", "collapsed"]
    seen = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed, r.text) for r in got.collect()]
    assert [(i, t) for i, _, _, t in seen] == rows
    assert [(i, runs, text) for i, runs, text, _ in seen] == [
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (5, [], "a a a a a"), (6, [(1, 6, 1)], "x Ab y"),
        (7, [(0, 8, 2)], "a b"), (8, [], "a b a b a b a c"), (9, [], "Word word Word word Word word"), (None, [(0, 7, 1)], "z"),
        (4, [(0, 6, 1)], "a"), (10, [(0, 8, 1)], " "), (11, [(0, 27, 3), (27, 8, 1)], "a b c d"),
    ]
    assert periodic.with_runs(docs.limit(0)).collect() == []


def test_planting_keeps_other_documents(spark, frame):
    rows = [(i, f"{i} b  c\nd e f g h i j") for i in range(200)] + [(None, "a b"), (3, None)]
    got = queries.with_planted_runs(frame(rows)).collect()
    assert len(got) == len(rows)
    changed = sum(r.text != t for r, (_, t) in zip(got, rows, strict=True))
    assert 5 < changed < 40
