import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tiltframe.llm import linededup
from tiltframe.llm.cuckoo import CuckooFilter

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_chars=10):
    """doc_id to (lines, dropped, kept text) by definition."""
    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_chars and doc is not None:
                holders.setdefault(key, set()).add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(line.strip(SPACE).translate(LOWER), set())
            if doc is None or len(own) < 2 or doc == min(own):
                kept.append(line)
        out.append((str(doc), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def rows(index, docs):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in index.deduplicated(docs).collect())


DOCS = [
    (1, "A shared line here\nown line of one\nshort"),
    (2, "  a SHARED line here\t\nshort\nÉtendue unique"),
    (3, "a shared line here\n\na shared line here\nétendue unique"),
    (5, None), (6, ""), (None, "a shared line here"), (7, "ten chars!\nten chars!"), (8, "ten chars!\r\nnine char"),
    (8, "nine char\nten chars!"), (9, "word " * 20000 + "\nA shared line here"),
]


def test_rules(spark, frame, tmp_path):
    docs = frame(DOCS)
    index = linededup.LineIndex(spark, str(tmp_path / "i"), 3).insert(docs)
    assert rows(index, docs) == plain(DOCS)
    digests = index.digests(docs).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in digests) == sorted(
        (d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain(DOCS)
    )
    assert set(index.deduplicated(docs).columns) == {*docs.columns, "n_lines", "n_dropped"}


def test_insertions_and_deletions_are_reversible(spark, frame, tmp_path):
    first, second = DOCS[:4], DOCS[6:]
    index = linededup.LineIndex(spark, str(tmp_path / "i"), 2).insert(frame(first))
    index.insert(frame(second))
    both = first + second
    assert rows(index, frame(both)) == plain(both)
    refs = {(bytes(r.key), r.refs, r.first_doc) for r in index.references().collect()}
    index.delete(frame([(1, ""), (7, ""), (99, "")]))
    left = [d for d in both if d[0] not in (1, 7)]
    assert rows(index, frame(left)) == plain(left)
    held = index.references().count()
    marks = sum(
        int((CuckooFilter.from_bytes(bytes(r.filter)).table != 0).sum()) for r in index.filters().collect()
    )
    assert marks == held
    index.insert(frame([d for d in both if d[0] in (1, 7)]))
    assert {(bytes(r.key), r.refs, r.first_doc) for r in index.references().collect()} == refs
    assert rows(index, frame(both)) == plain(both)


def test_empty_table(spark, frame, tmp_path):
    index = linededup.LineIndex(spark, str(tmp_path / "i"), 1).insert(frame([]))
    assert index.deduplicated(frame([])).count() == 0
    assert index.references().count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=400), st.data())
def test_cuckoo_filter_knows_what_it_holds(keys, data):
    keys = np.array(sorted(keys), np.uint64)
    cuckoo = CuckooFilter.for_keys(max(1, len(keys)))
    cuckoo.add(keys)
    gone = np.array([data.draw(st.booleans()) for _ in keys], bool) if len(keys) < 50 else np.arange(len(keys)) % 2 == 0
    cuckoo = CuckooFilter.from_bytes(cuckoo.to_bytes())
    assert cuckoo.contains(keys).all()
    cuckoo.remove(keys[gone])
    assert cuckoo.contains(keys[~gone]).all()
    assert cuckoo.full or int((cuckoo.table != 0).sum()) == int((~gone).sum())


def test_a_full_filter_says_maybe():
    cuckoo = CuckooFilter.for_keys(8)
    cuckoo.add(np.arange(10_000, dtype=np.uint64))
    assert cuckoo.full and cuckoo.contains(np.array([1 << 60], np.uint64)).all()


def test_building_in_batches_asks_the_filters(spark, frame, tmp_path, monkeypatch):
    docs = frame(DOCS * 2 + [(100 + i, f"a line of its own, {i}\nA SHARED line here") for i in range(40)])
    asked = []
    probe = linededup.LineIndex._maybe_known

    def spied(self, keys):
        found = probe(self, keys)
        asked.append((found.where("maybe").count(), found.where("NOT maybe").count()))
        return found

    monkeypatch.setattr(linededup.LineIndex, "_maybe_known", spied)
    index = linededup.indexed(docs, str(tmp_path / "i"), 3)
    whole = linededup.LineIndex(spark, str(tmp_path / "j"), 2).insert(docs)
    assert rows(index, docs) == rows(whole, docs)
    # The shared line is known to the later batches; nearly all lines that only one document holds are not.
    assert len(asked) == 2 and all(maybe >= 1 for maybe, _ in asked) and sum(new for _, new in asked) > 20
    references = {bytes(r.key): (r.refs, r.first_doc) for r in index.references().collect()}
    assert references == {bytes(r.key): (r.refs, r.first_doc) for r in whole.references().collect()}
