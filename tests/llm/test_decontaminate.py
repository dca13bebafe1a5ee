import random

import numpy as np
import pytest

from tiltframe.llm import decontaminate as dec


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def greedy(doc, item, k):
    """Greedy string tiling by definition, over word lists."""
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (
                    d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n]
                    and d + n not in marked_d and i + n not in marked_i
                ):
                    n += 1
                if n >= k and (best is None or (-n, i, d) < best):
                    best = (-n, i, d)
        if best is None:
            return out
        n, i, d = best
        out.append((d, i, -n))
        marked_d.update(range(d, d - n))
        marked_i.update(range(i, i - n))


@pytest.mark.parametrize("seed", range(6))
def test_tiles_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcd") for _ in range(30)]
    doc = [rng.choice("abcd") for _ in range(40)] + item[15:] + item[:15]
    places = [
        (d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]
    ]
    d, i = np.array(places).T
    assert dec.tiles(d, i, 3) == greedy(doc, item, 3)


def test_leaks(spark, frame):
    item, other = words(30, 1), words(20, 2)
    benchmark = spark.createDataFrame(
        [(1, " ".join(item)), (2, " ".join(other)), (3, "too short"), (4, None), (None, " ".join(item))],
        "item_id long, text string",
    )
    parts = [item[0:10], item[10:20], item[20:30]]
    docs = [
        (1, " ".join(words(50, 3) + item + words(9, 4))),
        (2, " ".join(parts[2] + words(5, 5) + parts[0] + ["and"] + parts[1])),
        (3, ". ".join(w.upper() for w in item)),
        (4, " ".join(words(20000, 6) + item[:12])),
        (5, None), (6, ""), (7, "too short"), (None, " ".join(item)),
        (8, " ".join(item)), (8, " ".join(item)), (9, " ".join(other + item)),
    ]
    got = {(r.doc_id, r.item_id): round(r.coverage, 6) for r in dec.leaks(frame(docs), benchmark).collect()}
    assert got == {(1, 1): 1, (2, 1): 1, (3, 1): 1, (8, 1): 1, (9, 1): 1, (9, 2): 1}
    kept = dec.decontaminated(frame(docs), benchmark)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "7", "None"]
    assert kept.columns == frame(docs).columns
    assert dec.leaks(frame([]), benchmark).count() == dec.leaks(frame(docs), benchmark.limit(0)).count() == 0


def test_whole_table_has_the_exact_passages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [r.text for r in benchmark.collect()]
    want = {d.doc_id for d in docs.collect() if any(t in (d.text or "") for t in texts)}
    assert {r.doc_id for r in dec.leaks(docs, benchmark).collect()} == want
