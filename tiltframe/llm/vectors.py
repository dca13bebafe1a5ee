"""Near duplicates of embeddings by spherical-cap filters of a structured product code.

A filter is a direction; a vector belongs to every filter with whose direction its product exceeds a
cap, which is such that a random vector is in a share of ``TAIL`` of all filters. Directions are not stored: a random rotation cuts the
vector into ``PARTS`` parts, each part has a small list of directions, and a filter is one word from
each list. The filters that a vector exceeds are decoded as a list, part by part, without trying
them all. ``CODES`` such codes with rotations of their own make misses independent. At 64 dimensions
a pair of cosine exactly 0.9 shares no filter once in about 1,500 times, one of 0.95 practically
never; unrelated pairs seldom share one.

Vectors meet in their filters. A filter's bucket is cut into cells of about ``CELL`` vectors, and each
pair of cells is one small matrix product: no pair of vectors is ever a row. A pair that meets in
several filters is counted in the first filter that both have. What leaves a pair of cells is one row
per vector: its number of links found there and the smallest vector that it reaches there.

Equal vectors collapse into one before all this and are counted back. Links are the pairs of cosine
at least ``SIMILARITY`` in double precision.

Vectors of one length are compared with each other, whatever that length; each length has its own codes
and jobs. Components are scaled by the largest one before the norm is taken, so neither very small nor
very large ones lose their direction. Vectors that are null, empty, zero, or hold null or non-finite
components, link with nothing; each is its own component. Rows that repeat an id count as separate vectors of that id: links are counted per row, and
the result has one row per row. Rows without an id are left out. An empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.llm.components import components
from tiltframe.llm.text import mix
from tiltframe.session import new_table_path

SIMILARITY = 0.9
SEED = 20_240_117
#: Independent codes; each has PARTS parts of WORDS directions, and WORDS ** PARTS filters.
CODES = 32
PARTS = 2
WORDS = 48
#: The share of filters that a random vector exceeds.
TAIL = 5.9e-4
CELL = 512


@functools.cache
def codes(dim: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Each code's rotation and the directions of its parts, the same in every process."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(CODES):
        rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        directions = []
        for part in np.array_split(np.arange(dim), min(PARTS, dim)):
            words = rng.standard_normal((WORDS, len(part)))
            directions.append(words / np.linalg.norm(words, axis=1, keepdims=True) * np.sqrt(len(part) / dim))
        out.append((rotation, directions))
    return out


@functools.cache
def least_product(dim: int, similarity: float) -> float:
    """The cap: a product that random directions exceed with probability ``TAIL``, but no more than
    ``similarity``, so that in few dimensions caps are still wide enough for two neighbours."""
    if dim < 4:
        return similarity
    x = np.linspace(-1, 1, 200_001)[1:-1]
    share = np.cumsum((1 - x * x)[::-1] ** ((dim - 3) / 2))
    return min(similarity, float(x[::-1][np.searchsorted(share, TAIL * share[-1])]))


def decode(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) of every filter that each unit vector exceeds, sorted. Part by part, only the
    beginnings are kept that the best words of the parts to come can still lift over the cap."""
    dim = unit.shape[1]
    owners, filters = [], []
    for c, (rotation, directions) in enumerate(codes(dim)):
        turned, at, products = unit @ rotation, 0, []
        for words in directions:
            products.append(turned[:, at : at + words.shape[1]] @ words.T)
            at += words.shape[1]
        owner, ids, sums = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, own in enumerate(products):
            rest = np.sum([p.max(1) for p in products[k + 1 :]], axis=0) if k + 1 < len(products) else np.zeros(len(unit))
            total = sums[:, None] + own[owner]
            a, b = np.nonzero(total >= (least - rest)[owner][:, None])
            owner, ids, sums = owner[a], ids[a] * WORDS + b, total[a, b]
        owners.append(owner)
        filters.append(ids + c * WORDS ** len(directions))
    owner, filter_ = np.concatenate(owners), np.concatenate(filters)
    order = np.lexsort((filter_, owner))
    return owner[order], filter_[order]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """The vectors of a binary column, all of one length, as unit rows in double precision."""
    if not len(column):
        return np.zeros((0, 1))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    x = flat.view(dtype).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the vectors that may link."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def near_duplicates(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row with an id."""
    kind = next((f.dataType for f in rows.schema if f.name == "embedding"), None)
    dtype = "<f4" if kind is not None and kind.simpleString() == "array<float>" else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Adding 0 makes the two zeros one.
            data = [(np.array(v.as_py(), dtype) + 0).tobytes() for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], ["vec_id", "vector"])

    vectors = _stored(usable(rows).mapInArrow(packed, "vec_id long, vector binary"), "vectors")
    rest = rows.select(F.col("vec_id").cast("long")).where("vec_id IS NOT NULL").exceptAll(vectors.select("vec_id"))
    found = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # A row for each length.
    for width in vectors.groupBy(F.length("vector").alias("width")).count().collect():
        found = found.unionByName(_linked(vectors.where(F.length("vector") == width.width), dtype, similarity))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(table: DataFrame, dtype: str, similarity: float) -> DataFrame:
    """vec_id, n_links and component_id of vectors of one length."""
    distinct = table.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = _stored(distinct, "distinct-vectors")
    copies = table.join(reps.select("vector", "rep", "copies"), "vector").select("vec_id", "rep", "copies")
    copies = _stored(copies, "vector-copies")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column(0), dtype)
            found, n = np.unique(decode(unit, least_product(unit.shape[1], similarity))[1], return_counts=True)
            yield pa.record_batch([pa.array(found), pa.array(n)], ["filter", "n"])

    # At most one row per filter, whose number is fixed.
    sizes = reps.select("vector").mapInArrow(counted, "filter long, n long").groupBy("filter").agg(F.sum("n").alias("n"))
    sizes = sizes.where("n > 1").toPandas()
    cells = np.zeros(CODES * WORDS**PARTS, np.int64)
    cells[sizes["filter"].to_numpy(np.int64)] = -(-sizes["n"].to_numpy(np.int64) // CELL)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                unit = _matrix(batch.column(1), dtype)
                owner, found = decode(unit, least_product(unit.shape[1], similarity))
                first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                sets = pa.array([found[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:])], pa.binary())
                many = cells[found]
                owner, found, many = owner[many > 0], found[many > 0], many[many > 0]
                ids = batch.column(0).to_numpy()[owner].astype(np.uint64)
                cell = (mix(ids ^ mix(found.astype(np.uint64))) % many.astype(np.uint64)).astype(np.int64)
                # A vector meets every cell of its filters' buckets.
                row = np.repeat(np.arange(len(owner)), many)
                other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                which = pa.array(owner[row])
                columns = [
                    pa.array(found[row]),
                    pa.array(np.minimum(cell[row], other)),
                    pa.array(np.maximum(cell[row], other)),
                    pa.array(cell[row]),
                    *(batch.column(i).take(which) for i in range(3)),
                    sets.take(which),
                ]
                yield pa.record_batch(columns, ["filter", "one", "two", "cell", "rep", "vector", "copies", "filters"])

    kinds = "filter long, one long, two long, cell long, rep long, vector binary, copies long, filters binary"
    meetings = reps.select("rep", "vector", "copies").mapInArrow(spread, kinds)
    meetings = meetings.repartition("filter", "one", "two").sortWithinPartitions("filter", "one", "two")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
                keys = np.stack([held.column(i).to_numpy() for i in range(3)])
                new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
                done = int(new[-1]) if len(new) else 0
            else:
                done = held.num_rows if held is not None else 0
            if done:
                ready = held.slice(0, done).combine_chunks().to_batches()[0]
                held = held.slice(done)
                yield _met(ready, dtype, similarity)

    met = meetings.mapInArrow(meet, "rep long, links long, low long")
    met = _stored(met.groupBy("rep", "low").agg(F.sum("links").alias("links")), "cap-links")
    roots = components(met.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    return (
        copies.join(links, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )


def _met(rows: pa.RecordBatch, dtype: str, similarity: float) -> pa.RecordBatch:
    """Links and edges of the pairs of cells in ``rows``, which are sorted by pair."""
    filter_, one, two, cell, ids, copies = (rows.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 6))
    units = _matrix(rows.column(5), dtype)
    sets = rows.column(7)
    new = (np.diff(filter_) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)
    starts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(filter_)]))
    out: list[np.ndarray] = []
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = np.arange(begin, end)
        same = one[begin] == two[begin]
        a = own[cell[own] == one[begin]]
        b = a if same else own[cell[own] == two[begin]]
        if not len(a) or not len(b):
            continue
        linked = units[a] @ units[b].T >= similarity
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        x, y = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        linked, a, b = linked[np.ix_(x, y)], a[x], b[y]
        # A pair is counted where the smallest filter that both have brings it together.
        known: dict[int, int] = {}
        marks = []
        for side in (a, b):
            smaller = []
            for r in side.tolist():
                f = np.frombuffer(sets[r].as_py(), "<i4")
                smaller.append([known.setdefault(v, len(known)) for v in f[f < filter_[begin]].tolist()])
            marks.append(smaller)
        if known:
            dense = []
            for smaller in marks:
                m = np.zeros((len(smaller), len(known)), np.float32)
                for i, at in enumerate(smaller):
                    m[i, at] = 1
                dense.append(m)
            fresh = linked & (dense[0] @ dense[1].T == 0)
        else:
            fresh = linked
        links = [fresh @ copies[b]] if same else [fresh @ copies[b], copies[a] @ fresh]
        sides = [a] if same else [a, b]
        for side, n in zip(sides, links, strict=True):
            out.append(np.stack((ids[side], n, ids[side])))
        edges = _chain(linked, ids[a], ids[b])
        out.append(np.stack((edges[:, 0], np.zeros(len(edges), np.int64), edges[:, 1])))
    table = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return pa.record_batch([pa.array(c, pa.int64()) for c in table], ["rep", "links", "low"])


def _chain(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """Edges (larger, smaller id) that join whatever the links of two cells join, no more than one per
    vector: each vector with the smallest one of its component there."""
    low = np.concatenate((ids_a, ids_b)).copy()
    n = len(ids_a)
    while True:
        side_b = np.where(linked, low[:n, None], np.iinfo(np.int64).max).min(0)
        new_b = np.minimum(low[n:], side_b)
        new_a = np.minimum(low[:n], np.where(linked, new_b[None, :], np.iinfo(np.int64).max).min(1))
        if (new_a == low[:n]).all() and (new_b == low[n:]).all():
            break
        low[:n], low[n:] = new_a, new_b
    edges = np.stack((np.concatenate((ids_a, ids_b)), low), axis=1)
    return edges[edges[:, 0] != edges[:, 1]]
