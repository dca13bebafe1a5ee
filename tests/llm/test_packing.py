import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tiltframe.llm import packing
from tiltframe.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
signs = st.text(alphabet=st.sampled_from("aZé ß \n\t\xa0　'stmdrevl123½²٣—$_\U0001f600中̂."), max_size=30)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(signs | st.text(max_size=20), max_size=8))
def test_ids_are_those_of_the_tokenizer(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_ids_are_those_of_the_tokenizer, "t") else test_ids_are_those_of_the_tokenizer.t
    test_ids_are_those_of_the_tokenizer.t = t
    t.encode_special_tokens = True
    found = encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [f.tolist() for f in found] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_long_runs_and_nulls(tokenizer):
    texts = [None, "", "x" * 5000, " \n" * 3000, "<|endoftext|> it's", None]
    found = encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [f.tolist() for f in found] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_one_id(spark, frame):
    default = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", None, "plain", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", ""]
    found = encoder(PATH, added=True).encode(pa.array(texts, pa.string()))
    assert found[0].tolist() == [64, 220, 50256, 275]
    assert [f.tolist() for f in found] == [default.encode(t or "", add_special_tokens=False).ids for t in texts]
    docs = list(enumerate(texts))
    check(packing.pack(packing.token_pieces(frame(docs), PATH, size=64), size=64).collect(), docs, default, 64)


def check(rows, docs, tokenizer, size):
    """Every rule of the packed rows; the number of sequences."""
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    want = Counter()
    for doc, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for i, (start, n) in enumerate(packing.cut(len(ids), size)):
            assert n == size or i == 0
            want[doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(filled)


def test_whole_table(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(packing.token_pieces(docs, PATH)).collect()
    used = check(rows, [(d.doc_id, d.text) for d in docs.collect()], tokenizer, 1024)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_edges(spark, frame, tokenizer):
    docs = [(1, None), (2, ""), (None, "a b"), (4, "same text"), (4, "same text"), (5, "w " * 700)]
    rows = packing.pack(packing.token_pieces(frame(docs), PATH, size=64), size=64).collect()
    check(rows, docs, tokenizer, 64)
    assert packing.pack(packing.token_pieces(frame([]), PATH)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_plan_uses_every_piece_once(counts):
    used = Counter()
    for line in packing.plan(counts, 32):
        assert sum(line.lengths) <= 32
        for x in line.lengths:
            used[x] += line.times
    assert used == Counter(counts)


def test_plan_closes_gaps_exactly():
    lines = packing.plan({20: 5, 12: 2, 7: 3, 5: 3}, 32)
    assert sum(line.times for line in lines) == 5
    assert sum(line.times for line in lines if sum(line.lengths) == 32) == 5


def test_one_frequent_length(spark, monkeypatch):
    """A length with many pieces has many chunks, and every place is taken once."""
    monkeypatch.setattr(packing, "CHUNKS", 1)
    monkeypatch.setattr(packing, "CHUNK", 50)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = [(i, 0, 0, 1024 if i % 4 else 300 + i % 7, 7) for i in range(2000)] + [(1, 0, 0, 1024, 7)] * 30
    got = packing.pack(spark.createDataFrame(rows, kinds)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows)
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(len(s) == 1 for s in spans.values()) >= 1530
