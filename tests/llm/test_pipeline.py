import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from test_decontaminate import words
from test_jaccard import plain as components_by_definition
from test_linededup import plain as lines_by_definition
from test_packing import PATH, check
from tiltframe.llm import toxicity


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 9 > 0), int(i % 3 == 0)) for i in range(150)] + [(None, 1, 1), (151, None, 1), (152, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def texts():
    for i in range(150):
        own = words(40, i)
        if i % 3 == 0:
            own[7:7] = [f"grubbl{'abcdefgh'[i % 8]}", "vile"]
        if i % 9 == 0:
            own += ["junk"] * 5
        yield i, " ".join(own)


def test_chain_finds_toxic_words_and_their_forms(spark, frame, labels):
    chain = toxicity.fit(frame(list(texts())), labels)
    assert chain.names == ("poor", "toxic") and len(chain.links[1]) == 1
    new = [(1000, "a grubblz walks in here"), (1001, "a quiet day by the sea"), (1002, None), (1003, ""), (None, "VILE grubblers!")]
    got = {r.doc_id: r.toxic for r in toxicity.score(frame(new), chain).collect()}
    assert got == {1000: True, 1001: False, 1002: False, 1003: False, None: True}
    kept = toxicity.without_toxic(frame(new), chain)
    assert sorted(r.doc_id for r in kept.collect()) == [1001, 1002, 1003] and kept.columns == frame(new).columns
    # Scores by definition: presence of each feature once.
    p = chain.probabilities(pa.array([t for _, t in texts()]))
    assert (p[:, 1] >= toxicity.THRESHOLD).tolist() == [i % 3 == 0 for i in range(150)]
    assert np.array_equal(chain.probabilities(pa.array(["vile vile"])), chain.probabilities(pa.array(["vile"])))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id")
    rows = judged.collect()
    hits = sum(r.toxic and r.label == 1 for r in rows)
    # A third of the toxic ones is in other languages, of which the fit has three examples or none.
    assert hits >= 0.6 * sum(r.label for r in rows)
    assert hits >= 0.97 * sum(r.toxic for r in rows)


@pytest.mark.parametrize("n", [30, 60, 100])
def test_few_labels(spark, frame, n):
    rows = [(i, " ".join(words(30, i) + ["gruzzle", "vilest"] * (i % 3 == 0))) for i in range(100)]
    given = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(frame(rows), toxicity.fit(frame(rows), given))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(100) if i % 3}


def test_labels_that_no_word_explains(spark, frame):
    """The share of toxic labels is no evidence against any document."""
    rows = [(i, " ".join(words(30, i))) for i in range(60)]
    given = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(frame([*rows, (60, ""), (61, None)]), toxicity.fit(frame(rows), given))
    assert {60, 61} <= {r.doc_id for r in kept.collect()}


def test_chain_against_a_plain_refit(spark, frame, labels, monkeypatch):
    """The chain by definition: counts, values, out-of-fold probabilities and Newton's method."""
    monkeypatch.setattr(toxicity, "ITERATIONS", 300)
    chain = toxicity.fit(frame(list(texts())), labels)
    column = pa.array([t for _, t in texts()])
    owner, hashed = toxicity.text_features(column)
    toxic, poor = (np.array([f(i) for i in range(150)], float) for f in (lambda i: i % 3 == 0, lambda i: i % 9 == 0))
    kinds, which = np.unique(hashed, return_inverse=True)
    docs = np.bincount(which)
    chis = []
    for y in (poor, toxic):
        ones = y.sum()
        chi = 150 * (np.bincount(which, y[owner]) * 150 - docs * ones) ** 2 / (docs * (151 - docs) * ones * (150 - ones))
        chis.append(np.where(docs >= toxicity.MIN_DOCS, chi, 0))
    best = [sorted(zip(-c, kinds.view(np.int64)))[: toxicity.FEATURES] for c in chis]
    chosen = np.unique([k for b in best for c, k in b if c < 0]).astype(np.int64).view(np.uint64)
    chosen.sort()
    assert np.array_equal(chain.features, chosen)
    x = np.zeros((150, len(chosen)))
    at = np.searchsorted(chosen, hashed)
    hit = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == hashed)
    x[owner[hit], at[hit]] = 1
    own = [np.sqrt(c[np.searchsorted(kinds, chosen)] / c.max()) for c in chis]
    rows = toxicity.labelled(frame(list(texts())), labels).select("doc_id", "fold").collect()
    fold = np.array([f for _, f in sorted(rows)])

    def fitted(x, y):
        w, z = np.zeros(x.shape[1] + 1), np.column_stack((x, np.ones(len(x))))
        penalty = np.append(np.full(x.shape[1], toxicity.PRIOR / len(x)), 0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(x) + np.diag(penalty + 1e-12), z.T @ (p - y) / len(x) + penalty * w)
        return lambda other: 1 / (1 + np.exp(-np.column_stack((other, np.ones(len(other)))) @ w))

    first, held = x * own[0], np.zeros(150)
    for f in range(toxicity.FOLDS):
        held[fold == f] = fitted(first[fold != f], poor[fold != f])(first[fold == f])
    p_poor = fitted(first, poor)(first)
    p_toxic = fitted(np.column_stack((x * own[1], held)), toxic)(np.column_stack((x * own[1], p_poor)))
    assert np.allclose(chain.probabilities(column), np.column_stack((p_poor, p_toxic)), atol=5e-3)


def test_without_labels_nothing_is_toxic(spark, frame, labels):
    docs = frame([(1, "vile"), (2, None)])
    for given in (labels.limit(0), labels.where("toxic = 0")):
        chain = toxicity.fit(docs, given)
        assert not any(r.toxic for r in toxicity.score(docs, chain).collect())
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, sf).cache()
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & gone) >= 0.9 * len(toxic) and not clean & gone
    rows = [(r.doc_id, r.text) for r in first.collect()]

    second = stages["line_dedup"](spark, first, sf).cache()
    lines = sorted((str(r.doc_id), r.text) for r in second.collect())
    assert lines == sorted((d, t) for d, _, _, t in lines_by_definition(rows))
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = stages["ngram_jaccard_join"](spark, second, sf).cache()
    by_definition = components_by_definition([(r.doc_id, r.text) for r in second.collect()], 5, 80)
    assert {r.doc_id for r in third.collect()} == {d for d, (_, c) in by_definition.items() if d == c}

    fourth = stages["benchmark_decontamination"](spark, third, sf).cache()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in fourth.collect()} == {
        r.doc_id for r in third.collect() if not any(t in r.text for t in items)
    }
    for df in (first, second, third, fourth):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    packed = stages["best_fit_packing"](spark, fourth, sf).collect()
    check(packed, [(r.doc_id, r.text) for r in fourth.collect()], tokenizer, 1024)
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_empty_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
