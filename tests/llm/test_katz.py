import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tiltframe.llm import katz

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Plain:
    """The model by definition, over dictionaries."""

    def __init__(self, docs, order=katz.ORDER):
        self.order = order
        self.held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        self.count = [Counter() for _ in range(order)]
        self.history = [Counter() for _ in range(order)]
        for d, text in docs:
            if not self.held(d):
                for past, t in self.positions(text):
                    for k in range(order):
                        h = past[len(past) - k :]
                        self.count[k][(h, t)] += 1
                        self.history[k][h] += 1
        self.one = {t: r for (_, t), r in self.count[0].items()}
        self.n = sum(self.one.values())
        of = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
        d = [katz.discounts(of(c)) for c in self.count]
        keep = 1 - 1 / (self.n + 2)
        self.kept = lambda k, r: d[k][r - 1] if r <= katz.K else keep
        self.unknown = 1 - math.fsum(self.kept(0, r) * r / self.n for r in self.one.values())
        self.alpha = [{} for _ in range(order)]
        for k in range(1, order):
            followers = defaultdict(list)
            for h, t in self.count[k]:
                followers[h].append(t)
            for h, f in followers.items():
                left = 1 - math.fsum(self.probability(h, t) for t in f)
                self.alpha[k][h] = left / (1 - math.fsum(self.probability(h[1:], t) for t in f))

    @staticmethod
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "<end>"]

    def positions(self, text):
        padded = ["<start>"] * (self.order - 1) + self.tokens(text)
        return [(tuple(padded[i : i + self.order - 1]), t) for i, t in enumerate(padded[self.order - 1 :])]

    def probability(self, h, t):
        k = len(h)
        r = self.count[k].get((h, t), 0)
        if r:
            return self.kept(k, r) * r / (self.history[k][h] if k else self.n)
        return self.alpha[k].get(h, 1.0) * self.probability(h[1:], t) if k else self.unknown

    def row(self, d, text):
        tokens = self.tokens(text)
        score = sum(math.log10(self.probability(h, t)) for h, t in self.positions(text))
        base = sum(math.log10((self.one.get(t, 0) + 1) / (self.n + len(self.one) + 1)) for t in tokens)
        return (self.held(d), len(tokens), sum(t in self.one for t in tokens), self.n, base, score)


def compare(df, docs, order=katz.ORDER):
    want = sorted(((str(d), *Plain.row(model, d, t)) for model in [Plain(docs, order)] for d, t in docs), key=str)
    got = sorted((str(r[0]), *r[1:]) for r in df.collect())
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    for g, w in zip(got, sorted(want), strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-7, abs=1e-7)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    compare(katz.score(docs), [(d.doc_id, d.text) for d in docs.collect()])


@pytest.mark.parametrize("order", [2, 3, 4])
def test_many_buckets_and_frequent_tokens(spark, sf, monkeypatch, order):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 5_000)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 3_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 100")
    compare(katz.score(docs.repartition(5), order), [(d.doc_id, d.text) for d in docs.collect()], order)


@pytest.mark.parametrize("order", [2, 3])
def test_stored_tables_score_other_texts(spark, sf, frame, tmp_path, monkeypatch, order):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 5_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    katz.score(docs, order, str(tmp_path / "model"))
    plain = Plain(rows, order)
    other = [(1000 + d, " ".join((t or "").split()[::-1])) for d, t in rows] + [(1, None), (2, "never seen"), (None, rows[3][1])]
    got = {r.doc_id: (r.n_tokens, r.score) for r in katz.score_stored(frame(other), str(tmp_path / "model")).collect()}
    assert len(got) == len(other)
    for d, t in other:
        row = plain.row(d, t)
        assert got[d] == (row[1], pytest.approx(row[5], rel=1e-7, abs=1e-7))
    # Each n-gram is stored once, with its count.
    stored = {r.order: r["count"] for r in katz.counts(spark, str(tmp_path / "model")).groupBy("order").count().collect()}
    assert stored == {k + 1: len(c) for k, c in enumerate(plain.count) if k}
    known = {r.n for r in katz.words(spark, str(tmp_path / "model")).groupBy().count().toDF("n").collect()}
    assert known == {len(plain.one) - 1}
    kinds = {r.order: r["count"] for r in katz.weights(spark, str(tmp_path / "model")).groupBy("order").count().collect()}
    assert kinds == {k + 1: len(a) for k, a in enumerate(plain.alpha) if k}


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up(order):
    docs = [(i, f"a b c a {'a b' if i % 2 else 'c'} w{i % 5} x{i}") for i in range(40)]
    plain = Plain(docs, order)
    assert 0 < plain.unknown < 1
    for k in range(1, order):
        for h in plain.alpha[k]:
            total = sum(plain.probability(h, t) for t in plain.one) + plain.probability(h, "unknown")
            assert total == pytest.approx(1)


def test_edges(spark, frame):
    docs = [(1, None), (2, ""), (3, "a b a b"), (3, "a b a b"), (4, "A  b\nc"), (None, "a z"), (5, "word " * 3000)]
    docs += [(i, f"a b w{i}") for i in range(10, 40)]
    compare(katz.score(frame(docs)), docs)
    assert katz.score(frame([])).count() == 0


def test_nothing_to_learn_from(spark, frame):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = katz.score(frame([(held, "a b")])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0, 0)


def test_discounts_fall_back_to_absolute():
    assert katz.discounts([4, 1, 0, 0, 0, 0]) == pytest.approx((np.arange(1, 6) - 4 / 6) / np.arange(1, 6))
    good = katz.discounts([1000, 400, 220, 140, 100, 75])
    assert ((good > 0) & (good < 1)).all() and (np.diff(good) > 0).all()


def test_one_bad_count_of_counts_keeps_good_turing():
    # The tokens of sf0.01: 5 n(5) / (4 n(4)) alone is above 1.
    n = [49663, 12919, 5197, 2729, 2383, 1067]
    kind, d = katz.chosen_discounts(n)
    assert kind == "Good-Turing, smoothed" and ((d > 0) & (d < 1)).all() and (np.diff(d) > 0).all()
    slope = np.polyfit(np.log(np.arange(1, 7)), np.log(n), 1)[0]
    r, common = np.arange(1, 6), 6.0 ** (1 + slope)
    assert d == pytest.approx((((r + 1) / r) ** (1 + slope) - common) / (1 - common))
    assert katz.chosen_discounts([1000, 400, 220, 140, 100, 75])[0] == "Good-Turing"
    assert katz.chosen_discounts([5000, 1200, 500, 0, 200, 120])[0] == "Good-Turing, smoothed"
    assert katz.chosen_discounts([10, 10, 10, 10, 10, 10])[0] == "absolute"
