"""Exact top-k by integer inner product: M-trees searched best first.

The components are whole numbers (see ``integers``). Within a tree, whose vectors have norms of at most
M, a vector x gets one more component sqrt(M^2 - |x|^2) and a query q gets 0 there. Then
``d(q, x)^2 = |q|^2 + M^2 - 2 q.x``: the nearest vectors are those of the highest scores, in a metric
space, which is what an M-tree needs.

Index. Some hundred pivots, a bounded sample of the rows, deal all rows out by the nearest pivot; a
pivot with more rows than a tree may hold has several trees, so equal vectors without number are split.
Each tree is built from pages of at most ``PAGE`` entries and stored as a table, one row per page. An
entry of an inner page is a routing vector with its covering radius, its distance to the routing vector
of the page above, and the page below; an entry of a leaf is a vector with its distance to the leaf's
routing vector.

Search. A query's pages wait in a heap by the least distance that anything below them can have, that is
distance to the routing vector less covering radius. Before a product is computed for an entry, the
stored distance to the parent and the known distance of query and parent bound it by the triangle
inequality, and entries beyond the k-th best are passed over. Every query first searches the tree that
its nearest pivot leads to; that gives its first k-th best. Then the roots of all trees are compared, in
blocks, and the query goes on in each tree that its bound cannot rule out.

Bounds are computed in doubles and loosened by ``SLACK``, so they never rule out a vector of the result.
Scores are exact: sums below 2^53 in doubles, others in Python's integers. A score beyond the range of a
long counts as that range's end.

Scores order vectors from high to low, equal ones by smaller vec_id. Rows with a null id, a null vector,
or any null or non-finite component take no part; vectors of other lengths than the query's are no
candidates of it. Rows that repeat an id are rows of their own: a query's candidates are all rows but its
own. A query without candidates gives no rows, as does an empty table. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltframe.llm.integers import (
    LONG_MAX, block_size, blocked, chunks_of, groups, highest, matrix, met, stored, whole_rows,
)

#: Entries of a page, and vectors of a tree at most.
PAGE = 128
TREE = 8192
#: Pivots are a sample of so many rows at most.
PIVOTS = 1024
#: Share of the norms by which bounds of distances are loosened; doubles err by far less.
SLACK = 1e-6
#: Roots in one block of the directory.
ROOTS = 1024


class Pages:
    """The pages of one tree, in memory while it is built or searched."""

    def __init__(self, norm: float):
        self.norm = norm  # M
        self.leaf: list[bool] = []
        self.vectors: list[np.ndarray] = []
        self.to_parent: list[np.ndarray] = []
        self.radius: list[np.ndarray] = []  # of inner pages
        self.below: list[np.ndarray] = []  # inner pages: page numbers; leaves: places of the rows

    def new(self) -> int:
        self.leaf.append(True)
        for column in (self.vectors, self.to_parent, self.radius, self.below):
            column.append(np.zeros(0))
        return len(self.leaf) - 1

    def put(self, page: int, leaf: bool, vectors, to_parent, radius, below) -> None:
        self.leaf[page] = leaf
        self.vectors[page], self.to_parent[page] = vectors, to_parent
        self.radius[page], self.below[page] = radius, below


def _distances(lifted: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(lifted - center).sum(1))


def build(x: np.ndarray) -> tuple[Pages, int, float]:
    """The pages of the tree over the rows of x (page 0 is the root), the place of the root's routing
    vector and the root's covering radius."""
    squares = np.square(x).sum(1)
    pages = Pages(float(np.sqrt(squares.max(initial=0))))
    lifted = np.column_stack((x, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))))
    center = int(np.argmin(np.square(lifted - lifted.mean(0)).sum(1)))
    away = _distances(lifted, lifted[center])
    reach = away.max(initial=0)
    todo = [(pages.new(), np.arange(len(x)), away)]
    while todo:
        page, own, away = todo.pop()
        if len(own) <= PAGE:
            pages.put(page, True, x[own], away, np.zeros(0), own)
            continue
        many = min(PAGE, -(-2 * len(own) // PAGE))
        routes = own[np.linspace(0, len(own) - 1, many).astype(np.int64)]
        products = lifted[own] @ lifted[routes].T
        nearest = np.argmin(np.square(lifted[routes]).sum(1) - 2 * products, axis=1)
        if np.bincount(nearest, minlength=many).max() > 0.9 * len(own):
            # Nearly all are alike: they are cut by number.
            nearest = np.arange(len(own)) * many // len(own)
        kept, radius, below = [], [], []
        for i in range(many):
            members = np.flatnonzero(nearest == i)
            if len(members):
                apart = _distances(lifted[own[members]], lifted[routes[i]])
                below.append(pages.new())
                kept.append(i)
                radius.append(apart.max())
                todo.append((below[-1], own[members], apart))
        routes = routes[kept]
        # Distances of the routing vectors to this page's own, which its entries know.
        parent = _place_of(own, away, routes)
        pages.put(page, False, x[routes], parent, np.array(radius), np.array(below))
    return pages, center, float(reach)


def _place_of(own: np.ndarray, away: np.ndarray, routes: np.ndarray) -> np.ndarray:
    """``away`` of the rows ``routes``, which are among ``own``."""
    order = np.argsort(own)
    return away[order[np.searchsorted(own[order], routes)]]


def exact(vectors: np.ndarray, q: np.ndarray, norms: float) -> np.ndarray:
    """The products of whole numbers; ``norms`` bounds the product of the norms."""
    if norms < 1 << 53:
        return (vectors @ q).astype(np.int64)
    whole = [int(b) for b in q.tolist()]
    sums = [sum(int(a) * b for a, b in zip(v, whole, strict=True)) for v in vectors.tolist()]
    return np.array([max(-LONG_MAX - 1, min(LONG_MAX, s)) for s in sums], np.int64)


class Search:
    """The k best rows of one tree for a query, and how many products that took."""

    def __init__(self, pages: Pages, ids: np.ndarray, rows: np.ndarray, center: np.ndarray, radius: float):
        self.pages, self.ids, self.rows, self.center, self.radius = pages, ids, rows, center, radius
        self.products = 0

    def best(self, q: np.ndarray, own: int, k: int, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best rows but ``own``, highest first. ``known``: the score of the
        k-th best so far; only rows that reach it are found."""
        pages = self.pages
        square, norm = float(q @ q), pages.norm
        whole = square + norm * norm
        slack = SLACK * (np.sqrt(square) + norm) + 1e-9
        norms = np.sqrt(square) * norm * (1 + SLACK)

        def distance(products: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(whole - 2 * products, 0))

        scores, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = np.inf if known is None else float(distance(np.float64(known))) + slack
        first = float(distance(self.center @ q))
        heap = [(max(first - self.radius, 0.0), 0, first)]
        while heap:
            least, page, to_parent = heapq.heappop(heap)
            if least > reach:
                break
            vectors, apart = pages.vectors[page], np.abs(to_parent - pages.to_parent[page])
            if pages.leaf[page]:
                may = np.flatnonzero(apart <= reach)
                where = pages.below[page][may]
                may, where = may[self.rows[where] != own], where[self.rows[where] != own]
                if not len(may):
                    continue
                self.products += len(may)
                found = exact(vectors[may], q, norms)
                if known is not None:
                    found, where = found[found >= known], where[found >= known]
                scores, places = np.concatenate((scores, found)), np.concatenate((places, where))
                if len(scores) > k:
                    order = np.lexsort((self.rows[places], self.ids[places]))
                    top = highest(scores[order], np.arange(len(order)), k)
                    scores, places = scores[order][top], places[order][top]
                if len(scores) == k:
                    worst = int(scores.min())
                    known = worst if known is None else max(known, worst)
                    reach = float(distance(np.float64(known))) + slack
            else:
                may = np.flatnonzero(apart - pages.radius[page] <= reach)
                self.products += len(may)
                away = distance(vectors[may] @ q)
                floor = np.maximum(away - pages.radius[page][may], 0)
                for d, p, a in zip(floor.tolist(), pages.below[page][may].tolist(), away.tolist(), strict=True):
                    if d <= reach:
                        heapq.heappush(heap, (d, int(p), a))
        order = np.lexsort((self.rows[places], self.ids[places], ~scores))
        return scores[order], places[order]


def _pivots(table: DataFrame, many: int) -> dict[int, np.ndarray]:
    """At most ``many`` vectors, those of the rows with the smallest hashes, by length."""
    sample = table.orderBy(F.xxhash64("row"), "row").limit(many).select("width", "vector").distinct().collect()
    out: dict[int, list[bytes]] = {}
    for r in sample:
        out.setdefault(r.width, []).append(bytes(r.vector))
    return {w: np.frombuffer(b"".join(sorted(v)), "<f8").reshape(len(v), w) for w, v in out.items() if w}


def forest(table: DataFrame, size: int, many: int) -> tuple[DataFrame, DataFrame]:
    """The pages of all trees, and the table with tree: the tree of each row."""
    pivots = _pivots(table, many)
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            bucket = -1 - widths.astype(np.int64)
            for width, own in pivots.items():
                here = np.flatnonzero(widths == width)
                x = matrix(batch.column("vector").take(pa.array(here)), width)
                away = np.square(own).sum(1) - 2 * (x @ own.T)
                bucket[here] = first[width] + np.argmin(away, axis=1)
            yield batch.append_column("bucket", pa.array(bucket))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    dealt, _ = blocked(table.mapInArrow(near, f"{kinds}, bucket long"), "bucket", size)
    dealt = stored(dealt.drop("bucket").withColumnRenamed("block", "tree"), "tree-rows")

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            ids, rows = group["vec_id"].to_numpy(), group["row"].to_numpy()
            width = group["width"][0].as_py()
            order = np.argsort(rows)
            x = matrix(group["vector"], width)[order]
            ids, rows = ids[order], rows[order]
            pages, center, radius = build(x)
            n = len(pages.leaf)

            def raw(arrays, dtype):
                return pa.array([np.ascontiguousarray(a, dtype).tobytes() for a in arrays], pa.binary())

            def of_leaves(values):
                return raw([values[b] if leaf else [] for b, leaf in zip(pages.below, pages.leaf, strict=True)], "<i8")

            yield pa.record_batch(
                [
                    pa.array([group["tree"][0].as_py()] * n), pa.array(range(n), pa.int32()), pa.array([width] * n, pa.int32()), pa.array(pages.leaf),
                    pa.array([pages.norm] * n), pa.array([radius] * n), raw([x[center]] * n, "<f8"), raw(pages.vectors, "<f8"), raw(pages.to_parent, "<f8"),
                    raw(pages.radius, "<f8"), raw(pages.below, "<i4"), of_leaves(ids), of_leaves(rows),
                ],
                PAGE_COLUMNS,
            )

    rows = dealt.select("tree", "row", "vec_id", "width", "vector").repartition("tree").sortWithinPartitions("tree")
    return stored(rows.mapInArrow(paged, PAGE_KINDS), "tree-pages"), dealt


#: A row for each page; norm, reach and center are the tree's, and center is only read at page 0.
PAGE_KINDS = (
    "tree long, page int, width int, leaf boolean, norm double, reach double, center binary, vectors binary, "
    "to_parent binary, radius binary, below binary, ids binary, rows binary"
)
PAGE_COLUMNS = [part.split()[0] for part in PAGE_KINDS.split(", ")]


def loaded(table: pa.Table) -> Search:
    """A tree from the rows of its pages."""
    rows = sorted(table.select(PAGE_COLUMNS[1:]).to_pylist(), key=lambda r: r["page"])
    pages = Pages(rows[0]["norm"])
    width, ids, own = rows[0]["width"], [], []
    at = 0
    for r in rows:
        held = np.frombuffer(r["ids"], "<i8")
        below = np.frombuffer(r["below"], "<i4")
        if r["leaf"]:
            # Within the search, a row's place is its number among the rows of all leaves.
            below = np.arange(at, at + len(held))
            at += len(held)
            ids.append(held)
            own.append(np.frombuffer(r["rows"], "<i8"))
        vectors = np.frombuffer(r["vectors"], "<f8").reshape(len(below), width)
        pages.put(pages.new(), r["leaf"], vectors, np.frombuffer(r["to_parent"], "<f8"), np.frombuffer(r["radius"], "<f8"), below)
    return Search(pages, np.concatenate(ids), np.concatenate(own), np.frombuffer(rows[0]["center"], "<f8"), rows[0]["reach"])


def _searched(pages: DataFrame, asking: DataFrame, k: int, chunks: int) -> DataFrame:
    """row, score, vec_id, other of the k best rows in each query's tree; asking: tree, row, vector, known."""

    def search(block: pa.Table, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        tree = loaded(block)
        vectors = matrix(queries["vector"], block["width"][0].as_py())
        out = []
        for q, row, known in zip(vectors, queries["row"].to_pylist(), queries["known"].to_pylist(), strict=True):
            scores, places = tree.best(q, row, k, known)
            out.append((np.full(len(scores), row), scores, tree.ids[places], tree.rows[places]))
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)]
        yield pa.record_batch(columns, ["row", "score", "vec_id", "other"])

    own = pages.withColumnRenamed("tree", "block")
    asking = asking.select(F.col("tree").alias("block"), "row", "vector", "known")
    return met(own, asking, chunks, "row long, score long, vec_id long, other long", search)


def _ruled_in(roots: DataFrame, n_trees: int, asking: DataFrame, chunks: int) -> DataFrame:
    """tree, row, vector, known for each tree, but the query's first one, that the bound of the root
    does not rule out; asking: row, first, width, vector, known."""
    blocks = max(1, -(-n_trees // ROOTS))

    def compare(block: pa.Table, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        own_widths, widths = block["own_width"].to_numpy(), queries["width"].to_numpy()
        for width in np.unique(own_widths).tolist():
            here = np.flatnonzero(own_widths == width)
            centers = matrix(block["center"].take(pa.array(here)), width)
            norms, reach = block["norm"].to_numpy()[here], block["reach"].to_numpy()[here]
            trees = block["tree"].to_numpy()[here]
            there = np.flatnonzero(widths == width)
            for at in range(0, len(there), 1024):
                tile = queries.take(pa.array(there[at : at + 1024]))
                q = matrix(tile["vector"], width)
                square = np.square(q).sum(1)[:, None]
                whole = square + norms * norms
                slack = 2 * SLACK * (np.sqrt(square) + norms) + 1e-9
                known = tile["known"].to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                # A query with fewer than k candidates so far has no known score, and goes everywhere.
                least = np.sqrt(np.maximum(whole - 2 * (q @ centers.T), 0)) - reach
                far = np.where(np.isnan(known), np.inf, np.sqrt(np.maximum(whole - 2 * known, 0)))
                a, b = np.nonzero((least <= far + slack) & (trees != tile["first"].to_numpy()[:, None]))
                which = pa.array(a)
                yield pa.record_batch(
                    [pa.array(trees[b]), *(tile[c].take(which).combine_chunks() for c in ("row", "vector", "known"))],
                    ["tree", "row", "vector", "known"],
                )

    own = roots.select((F.col("tree") % blocks).alias("block"), "tree", F.col("width").alias("own_width"), "norm", "reach", "center")
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return met(own, asking, chunks, "tree long, row long, vector binary, known long", compare)


def top_k(rows: DataFrame, queries: Column, k: int = 10, scale: float = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest products of each row of ``queries`` with
    all other rows."""
    table = whole_rows(rows, scale, asks=F.coalesce(queries, F.lit(False)))
    facts = table.agg(F.count(F.lit(1)), F.max("width"), F.count_if("asks")).first()
    n, width, n_queries = facts[0], facts[1] or 0, facts[2]
    size, chunks = min(TREE, block_size(n, width)), chunks_of(n_queries)
    pages, dealt = forest(table, size, min(PIVOTS, max(1, -(-n // size))))
    asking = dealt.where("asks").select("row", F.col("vec_id").alias("query_id"), "tree", "width", "vector")
    begun = _searched(pages, asking.withColumn("known", F.lit(None).cast("long")), k, chunks)
    begun = stored(begun, "first-trees")
    known = begun.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("known"))
    roots = pages.where("page = 0")
    n_trees = roots.count()
    rest = asking.withColumnRenamed("tree", "first").join(known, "row", "left").drop("query_id")
    ruled_in = _ruled_in(roots, n_trees, rest, chunks)
    found = begun.unionByName(_searched(pages, ruled_in, k, chunks))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.join(asking.select("row", "query_id"), "row").select("query_id", "rank", "vec_id", "score")
