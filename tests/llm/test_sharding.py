import zlib

from tiltframe.llm import sharding


def check(rows, docs, shards):
    sizes = [0] * shards
    places = [[] for _ in range(shards)]
    for r in rows:
        sizes[r.shard] += r.size
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(p) == list(range(len(p))) for p in places)
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    return sizes


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_by_bytes(docs, 24).collect()
    sizes = check(rows, [(d.doc_id, d.text) for d in docs.collect()], 24)
    assert max(sizes) < 1.05 * sum(sizes) / 24
    assert len({(r.doc_id, r.virtual_slot) for r in rows}) == len(rows)


def test_edges(spark, frame):
    docs = [(None, None), (None, "x"), (1, "a"), (1, "a"), (1, "b"), (2, "é" * 9000)]
    check(sharding.shard_by_bytes(frame(docs), 3).collect(), docs, 3)
    assert sharding.shard_by_bytes(frame([]), 3).count() == 0


def test_the_map_is_versioned_and_edited(spark, tmp_path):
    current = sharding.even_map(64, 4)
    sizes = [100 if slot % 4 == 0 else 10 for slot in range(64)]
    new = sharding.rebalanced(current, sizes, 4)
    totals = [sum(s for s, shard in zip(sizes, new, strict=True) if shard == k) for k in range(4)]
    assert max(totals) - min(totals) <= 10
    assert sum(a != b for a, b in zip(current, new, strict=True)) < 32
    path = str(tmp_path / "map")
    sharding.write_map(spark, path, 1, current)
    sharding.write_map(spark, path, 2, new)
    for version, want in ((1, current), (2, new), (None, new)):
        got = sharding.read_map(spark, path, version).orderBy("virtual_slot").collect()
        assert [r.shard for r in got] == want


def test_equal_ids_get_equal_slots_at_any_time(spark, frame):
    docs = [(i, f"text {i}") for i in range(50)]
    one = {r.doc_id: r.virtual_slot for r in sharding.slotted(frame(docs)).collect()}
    two = {r.doc_id: r.virtual_slot for r in sharding.slotted(frame(docs[::2])).collect()}
    assert all(one[d] == s for d, s in two.items())
