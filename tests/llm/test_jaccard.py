import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tiltframe.llm import jaccard
from tiltframe.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(docs, k, percent):
    """doc_id to (set size, component) by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        common = Counter(o for x in s for o in holders[x])
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def found(docs, k, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs, k, percent).collect()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_whole_table(spark, sf, k, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs, k, percent) == plain([(d.doc_id, d.text) for d in docs.collect()], k, percent)


def near_copies(seed):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for family in range(12):
        base = common[:40] + [f"f{family}w{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))]
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(words[: len(words) - rng.randrange(0, 4)]))
    docs += [" ".join(common[i : i + 12]) for i in range(20)] + [" ".join(common[i : i + 11]) for i in range(20)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_families_that_share_a_passage(spark, frame, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    docs = near_copies(seed)
    assert found(frame(docs), 3, 90) == plain(docs, 3, 90)


def test_edges(spark, frame):
    long = " ".join(f"w{i}" for i in range(30000))
    docs = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "É un deux"),
        (8, "é un deux"), (10, long), (9, long + " more"), (11, "a b c d e f g h i j k l"), (12, "a b c d e f g h i j k"),
    ]
    assert found(frame([*docs, (None, "one two")]), 3, 90) == plain(docs, 3, 90)
    assert found(frame([]), 3, 90) == {}


def test_repeated_ids_are_one_document(spark, frame):
    docs = [(1, "a b c d"), (2, "a b c d"), (2, "e f g h i"), (3, "e f g h i"), (2, "a b c d")]
    assert found(frame(docs), 3, 90) == {1: (2, 1), 2: (3, 1), 3: (3, 1)}
    kept = jaccard.one_of_each(frame([*docs, (None, "x")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert kept.columns == frame(docs).columns


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 7), (50, 51), (51, 50), (60, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(31), 100]}, 50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_batches_are_bounded_in_bytes(spark):
    """Two hundred texts of 100 KB do not reach a worker in one batch of 20 MB."""
    texts = spark.range(200).coalesce(1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    got = jaccard._stored(texts.mapInArrow(sizes, "n long, bytes long"), "batches").toPandas()
    assert got["n"].sum() == 200 and got["bytes"].max() < 4 << 20
