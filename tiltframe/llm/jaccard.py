"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct runs of ``k`` words, as 64-bit hashes. Two documents link when
``100 * |intersection| >= percent * |union|``; the result is one row per document with the component
that links lead to.

1. Documents of equal sets collapse into one set (by size and two sums of its hashes).
2. In a common order of all hashes, a set of n can only link with one that shares a hash with its
   first ``n - ceil(t n) + 1`` ones, its prefix. The order is by hash, but with frequent hashes last:
   those found in at least ``FREQUENT`` sets, counted as far as prefixes can reach, are kept as a bitmap
   of fixed size. Any bitmap gives a right order; a good one makes prefixes rare.
3. Sets with the same prefix and size become one group, and only groups are joined, on the hashes of
   their prefixes. First each group meets, in each prefix hash, the one of similar size with the fewest rare hashes (in
   a family of copies, the one with the fewest changes). Pairs
   that pass the filters are expanded into members and verified on whole sets, which are hashed again
   from the texts of candidates only. Links make components; then only groups of different components
   still meet, on hashes that more than one component has. A large family of near copies is one
   component after the first round and is never paired out.

Filters of a pair of groups, within the join: sizes within the threshold; the overlap that the places
of the shared hash in the two prefixes still allow, where two sets that meet on a frequent hash need
not count on their rare ones (had they one in common they would meet there, as all of them come
first); and a bitmap of 64 equal ranges of hashes, where a range that only one set is in is a hash
that is not common. The rows of a frequent hash are first joined by their kinds (size, places), then
by kind and component, so that a family of copies is compared as a few kinds. Filter of a pair of members: each set has a sketch, the
number of its hashes in each of ``RANGES`` equal ranges, and no more hashes can be common than the
smaller numbers add up to.

Words are parted by ASCII white space with A-Z lower-cased. A text of fewer than ``k`` words is one
run; null, empty or blank texts have no set and link with nothing, not even each other. Rows that
repeat an id are taken as one document of the union of their rows' links, with the largest of their
set sizes. Rows without an id are not part of the result. An empty table gives no rows. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.llm.bitmap import hash_bitmap, may_hold
from tiltframe.llm.components import components
from tiltframe.llm.text import mix, shingle_sets, slices, word_hashes
from tiltframe.session import new_table_path, text_batches

#: Sets that share a hash from which on it is ordered last.
FREQUENT = 24
RANGES = 256
#: What the filters of a pair know of a group, besides its ranges.
KIND = ["n", "place", "rare"]


def prefix_size(n: int, percent: int) -> int:
    """Hashes of a set of n that a partner must share one of."""
    return n - -(-percent * n // 100) + 1


def smallest_linked(percent: int) -> int:
    """The smallest set that can link with another one than itself."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def _batches(docs: DataFrame):
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    with text_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    places = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=places[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(flat.view(np.int64)))


def _frequent_among(docs: DataFrame, chosen) -> np.ndarray:
    """The bitmap of the hashes that ``chosen`` picks from many sets."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(*word_hashes(batch.column(1)), k)
            parts = [chosen(s) for s in sets if len(s)]
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            # Counted before they are sent, as far as one batch goes.
            found, n = np.unique(found, return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], ["hash", "n"])

    k = chosen.keywords["k"]
    counts = _batches(docs).mapInArrow(picked, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    with text_batches(docs.sparkSession):
        return hash_bitmap(counts.where(F.col("n") >= FREQUENT), "hash")


def _opening(s: np.ndarray, k: int, percent: int) -> np.ndarray:
    return s[: 2 * prefix_size(len(s), percent)]


def _behind(s: np.ndarray, k: int, percent: int, bitmap: np.ndarray) -> np.ndarray:
    """What lies behind the opening of a set whose opening cannot fill its prefix with rare hashes."""
    p = prefix_size(len(s), percent)
    rare = int((~may_hold(bitmap, s[: 2 * p])).sum())
    return s[2 * p :] if rare < p else s[:0]


def frequent_hashes(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """The bitmap of the frequent hashes that prefixes may meet: those that many sets have within
    twice their prefix, and, of sets that are too full of those, the others that many have."""
    first = _frequent_among(docs, partial(_opening, k=k, percent=percent))
    second = _frequent_among(docs, partial(_behind, k=k, percent=percent, bitmap=first))
    return first | second


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes are in each range; nothing if a number does not fit."""
    counts = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else b""


def set_table(docs: DataFrame, k: int, percent: int, bitmap: np.ndarray) -> DataFrame:
    """doc_id, n (set size), two sums over the set, the prefix in the common order, how many of it are
    rare, the ranges the set is in, and the sketch of a set that has a prefix."""
    least = smallest_linked(percent)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(*word_hashes(batch.column(1)), k)
            sums, others, prefixes, rare, bits = [], [], [], [], []
            for s in sets:
                sums.append(s.sum(dtype=np.uint64))
                others.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                p = prefix_size(len(s), percent) if len(s) >= least else 0
                late = may_hold(bitmap, s) if p else None
                prefixes.append(np.concatenate((s[~late][:p], s[late][:p]))[:p] if p else s[:0])
                rare.append(min(p, int((~late).sum())) if p else 0)
                bits.append(np.bitwise_or.reduce(np.uint64(1) << (s >> np.uint64(58))) if p else np.uint64(0))
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array(sums, np.uint64).view(np.int64)),
                pa.array(np.array(others, np.uint64).view(np.int64)),
                _lists(prefixes),
                pa.array(rare, pa.int64()),
                pa.array(np.array(bits, np.uint64).view(np.int64)),
                pa.array([sketch(s) if len(p) else b"" for s, p in zip(sets, prefixes, strict=True)], pa.binary()),
            ]
            yield pa.record_batch(columns, ["doc_id", "n", "sum1", "sum2", "prefix", "rare", "bits", "sketch"])

    kinds = "doc_id long, n long, sum1 long, sum2 long, prefix array<long>, rare long, bits long, sketch binary"
    return _batches(docs).mapInArrow(described, kinds)


def _candidate_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id and its sorted set as bytes, for the documents in ``wanted`` (doc_id, distinct): those
    that a bitmap of the ids lets pass are hashed, then joined exactly."""
    mark = F.xxhash64("doc_id")
    bitmap = hash_bitmap(wanted.select(mark.alias("mark")), "mark")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            batch = batch.filter(pa.array(may_hold(bitmap, batch.column(2).to_numpy().view(np.uint64))))
            sets = shingle_sets(*word_hashes(batch.column(1)), k)
            data = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.record_batch([batch.column(0), data], ["doc_id", "set"])

    found = _batches(docs).withColumn("mark", mark).mapInArrow(hashed, "doc_id long, set binary")
    # Rows that repeat an id and differ in text: any of them may be meant, so all are kept.
    return found.join(wanted, "doc_id", "left_semi")


def _hopeful(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u2"), np.frombuffer(y.as_py(), "<u2")
                most = int(np.minimum(x, y).sum(dtype=np.int64)) if len(x) == len(y) else 0
                total = int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64))
                keep.append(not len(x) or not len(y) or 100 * most >= percent * (total - most))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b")
    return met.mapInArrow(judged, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose whole sets link."""
    pairs = _stored(_hopeful(pairs, reps, percent), "hopeful-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _stored(_candidate_sets(docs, wanted, k), "candidate-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), max(0, len(large) - 1))
                both = int((large[at] == small).sum()) if len(large) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return met.mapInArrow(judged, "a long, b long")


def linked(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document with an id."""
    table = _stored(set_table(docs, k, percent, frequent_hashes(docs, k, percent)), "sets")
    # 1. One representative per set.
    of_set = table.where("n > 0").groupBy("n", "sum1", "sum2").agg(
        F.min("doc_id").alias("rep"),
        *(F.min(c).alias(c) for c in ("prefix", "rare", "bits", "sketch")),
    )
    reps = _stored(of_set, "set-representatives")
    copies = (
        table.where("n > 0")
        .select("doc_id", "n", "sum1", "sum2")
        .join(reps.select("n", "sum1", "sum2", "rep"), ["n", "sum1", "sum2"])
        .where("doc_id <> rep")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    # 3. One group per prefix and size.
    members = reps.where(F.size("prefix") > 0).withColumn("print", F.xxhash64("prefix"))
    firsts = members.groupBy("n", "print").agg(
        F.min("rep").alias("grp"),
        F.min("prefix").alias("prefix"),
        F.min("rare").alias("rare"),
        F.bit_and("bits").alias("every"),
        F.bit_or("bits").alias("some"),
        F.count(F.lit(1)).alias("size"),
    )
    groups = _stored(firsts, "groups")
    member_of = _stored(members.join(groups.select("n", "print", "grp"), ["n", "print"]).select("rep", "grp"), "members")
    index = groups.select("grp", "n", "rare", "every", "some", "size", F.posexplode("prefix").alias("place", "hash"))
    shared = index.groupBy("hash").agg(F.sum("size").alias("sets")).where("sets > 1").select("hash")
    index = _stored(index.join(shared, "hash").drop("size"), "prefix-index")

    # Members of one group: each against the group's first, then the rest among themselves.
    inside = member_of.where("rep <> grp").select(F.col("rep").alias("a"), F.col("grp").alias("b"))

    ratio = percent / 100
    step = float(-1 / np.log(ratio))
    banded = index.withColumn("band", F.floor(F.log(F.col("n").cast("double")) * step))
    low = banded.groupBy("hash", "band").agg(
        F.min(F.struct("rare", "grp", "n", "place", "every", "some")).alias("low"), F.count(F.lit(1)).alias("sets")
    )
    low = _second(low.where("sets > 1").select("hash", "band", "low.*"), ["hash", "band"])
    near = banded.join(low, ["hash", "band"]).where("grp <> grp2").where(_allowed(percent))
    met = near.select(F.col("grp").alias("a"), F.col("grp2").alias("b")).distinct()
    first_pairs = _stored(inside.unionByName(met).distinct(), "first-pairs")
    first_links = _stored(_verified(docs, first_pairs, reps, k, percent), "first-links")
    first = _stored(components(first_links), "first-components")

    # What is not yet in one component. Groups stand with all members that their first is not linked to.
    rep_root = member_of.join(first.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "grp", F.coalesce("root", "rep").alias("root")
    )
    heads = _stored(rep_root.select("grp", "root").distinct(), "group-components")
    open_hashes = (
        index.join(heads, "grp")
        .groupBy("hash")
        .agg(F.min("root").alias("lowest"), F.max("root").alias("highest"))
        .where("lowest <> highest")
        .select("hash")
    )
    rest = _stored(
        index.join(open_hashes, "hash").join(heads, "grp"), "open-index"
    )
    group_pairs = _crossing(rest, percent)
    one = rep_root.select("grp", "root", F.col("rep").alias("a"))
    two = rep_root.select(F.col("grp").alias("grp2"), F.col("root").alias("root2"), F.col("rep").alias("b"))
    expanded = group_pairs.join(one, ["grp", "root"]).join(two, ["grp2", "root2"]).select("a", "b")
    tried = first_pairs.unionByName(first_pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second_pairs = _stored(expanded.distinct().join(tried, ["a", "b"], "left_anti"), "second-pairs")
    second_links = _stored(_verified(docs, second_pairs, reps, k, percent), "second-links")

    edges = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    edges = edges.unionByName(second_links).unionByName(copies)
    found = components(edges)
    sizes = table.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def _second(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` as the other side of a join on ``keys``."""
    return rows.toDF(*(c if c in keys else f"{c}2" for c in rows.columns))


def _crossing(index: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups of different components (grp, root, grp2, root2) that meet on a hash and pass."""
    rare = index.where("place < rare")
    found = rare.join(_second(rare, ["hash"]), "hash").where("root < root2").where(_allowed(percent))
    ends = ["grp", "root", "grp2", "root2"]

    late = index.where("place >= rare")
    bits = (F.bit_and("every").alias("every"), F.bit_or("some").alias("some"))
    kinds = late.groupBy("hash", *KIND).agg(F.min("root").alias("low"), F.max("root").alias("high"), *bits)
    kind_pairs = (
        kinds.join(_second(kinds, ["hash"]), "hash")
        .where(_allowed(percent))
        .where("least(low, low2) < greatest(high, high2)")
        .select("hash", *KIND, *(f"{c}2" for c in KIND))
    )
    by_root = late.groupBy("hash", *KIND, "root").agg(*bits)
    first = ["hash", *KIND]
    second = ["hash", *(f"{c}2" for c in KIND)]
    root_pairs = (
        kind_pairs.join(by_root, first)
        .join(_second(by_root, ["hash"]), second)
        .where("root < root2")
        .where(_allowed(percent))
        .select("n", "rare", "root", "n2", "rare2", "root2")
        .distinct()
    )
    # Once per pair of components and sizes, not once per hash; groups that do not share the hash may
    # be among them, and fail later.
    members = late.select("n", "rare", "root", "grp").distinct()
    met = root_pairs.join(members, ["n", "rare", "root"]).join(_second(members, []), ["n2", "rare2", "root2"])
    return found.select(*ends).unionByName(met.select(*ends)).distinct()


def _allowed(percent: int):
    """If two groups that meet on a hash (its ``place`` in both prefixes) may have linked members."""
    n, m = F.col("n"), F.col("n2")
    late = F.col("place") >= F.col("rare")
    before = F.least(
        F.when(late, F.col("place") - F.col("rare")).otherwise(F.col("place")),
        F.when(late, F.col("place2") - F.col("rare2")).otherwise(F.col("place2")),
    )
    most = F.least(
        before + 1 + F.least(n - F.col("place") - 1, m - F.col("place2") - 1),
        n - F.bit_count(F.col("every").bitwiseAND(F.bitwise_not("some2"))),
        m - F.bit_count(F.col("every2").bitwiseAND(F.bitwise_not("some"))),
    )
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & (100 * most >= percent * (n + m - most))
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a smaller id in their component. Rows without an id are
    kept; all rows of a kept id are kept."""
    gone = linked(docs, k, percent).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
