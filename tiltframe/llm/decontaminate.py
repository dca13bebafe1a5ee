"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) and parted by white space and ASCII signs. Every run of ``MIN_MATCH``
words of a benchmark item is a seed; documents are searched for seeds by a rolling (Karp-Rabin) hash
of the same width, and joined on them. A pair of document and item whose seeds could cover enough of
the item is then tiled: equal runs are seeds that follow each other in both texts; the longest equal
run of words that are not marked yet becomes a tile and its words are marked in both, until no run
of ``MIN_MATCH`` words is left. A tile may come from anywhere in the document, so a passage whose
parts were put in another order is covered like the original. A pair counts as a leak if its tiles
cover ``COVERAGE`` of the item's words.

Tiling needs no texts, only the places of the seeds in both, so no text is moved. The document side
is filtered by a bitmap of fixed size before the join. Both sides of the join may hold frequent
seeds: it is an ordinary join that Spark splits; the rows of one pair are bounded by the product of
the places of its seeds in the two texts, and meet in one group per pair.

Null or empty texts, texts and items of fewer than ``MIN_MATCH`` words match nothing. Rows without an
id are never reported. Rows that repeat an id are one document, or item, with the places of all of
them. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.llm.bitmap import hash_bitmap, may_hold
from tiltframe.llm.text import slices, window_hashes, word_hashes
from tiltframe.session import new_table_path

MIN_MATCH = 4
COVERAGE = 0.6


def seeds(rows: DataFrame, key: str, min_match: int = MIN_MATCH, bitmap: np.ndarray | None = None) -> DataFrame:
    """(key, seed, place, n_words) of every seed of every text, or of those that the bitmap may hold."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words, first = word_hashes(batch.column(1), plain=True)
            runs = window_hashes(words, min_match)
            sizes = np.diff(first)
            owner = np.repeat(np.arange(len(sizes)), sizes)[: len(runs)]
            inside = np.arange(len(runs)) + min_match <= first[1:][owner]
            if bitmap is not None:
                inside &= may_hold(bitmap, runs)
            at = np.flatnonzero(inside)
            own = owner[at]
            ids = batch.column(0).to_numpy()[own]
            columns = (ids, runs[at].view(np.int64), at - first[own], sizes[own])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], [key, "seed", "place", "n_words"])

    texts = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(found, f"{key} long, seed long, place long, n_words long")


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of the places where seeds agree: (place in the document, place in the item,
    words) of each tile, longest first; of equal ones the first in the item, then in the document."""
    order = np.lexsort((doc, doc - item))
    doc, item = doc[order], item[order]
    if not len(doc):
        return []
    fresh = np.concatenate(([True], (np.diff(doc) != 1) | (np.diff(item) != 1)))
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(doc))) + min_match - 1
    heap = [(-n, i, d) for n, d, i in zip(sizes.tolist(), doc[starts].tolist(), item[starts].tolist(), strict=True)]
    heapq.heapify(heap)
    taken_doc: set[int] = set()
    taken_item: set[int] = set()
    out = []
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [d + k not in taken_doc and i + k not in taken_item for k in range(-n)]
        if all(free):
            out.append((d, i, -n))
            taken_doc.update(range(d, d - n))
            taken_item.update(range(i, i - n))
            continue
        run = 0
        for k, ok in enumerate([*free, False]):
            if ok:
                run += 1
            else:
                if run >= min_match:
                    heapq.heappush(heap, (-run, i + k - run, d + k - run))
                run = 0
    return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE
) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles, coverage, contaminated (always true) of
    every pair of document and item that is a leak."""
    spark = docs.sparkSession
    path = new_table_path(spark, "item-seeds")
    seeds(benchmark, "item_id", min_match).write.parquet(path)
    items = spark.read.parquet(path).distinct()
    hits = seeds(docs, "doc_id", min_match, hash_bitmap(items, "seed"))
    hits_path = new_table_path(spark, "seed-hits")
    hits.select("doc_id", "seed", "place").write.parquet(hits_path)
    hits = spark.read.parquet(hits_path).withColumnRenamed("place", "doc_place")
    met = hits.join(items.withColumnRenamed("place", "item_place"), "seed")
    # Each place begins a seed, which covers no more than its own words.
    hopeful = (
        met.groupBy("doc_id", "item_id", "item_place")
        .agg(F.max("n_words").alias("n_words"))
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("places"), F.max("n_words").alias("n_words"))
        .where(F.col("places") * min_match >= coverage * F.col("n_words"))
        .select("doc_id", "item_id")
    )
    kept = met.join(hopeful, ["doc_id", "item_id"])

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc_place", "item_place"])
        found = tiles(rows["doc_place"].to_numpy(), rows["item_place"].to_numpy(), min_match)
        n, covered = int(rows["n_words"].max()), sum(t[2] for t in found)
        row = (*map(int, key), n, covered, len(found), covered / n)
        names = ["doc_id", "item_id", "item_words", "covered_words", "tiles", "coverage"]
        return pd.DataFrame([row], columns=names)

    kinds = "doc_id long, item_id long, item_words long, covered_words long, tiles long, coverage double"
    tiled = kept.select("doc_id", "item_id", "doc_place", "item_place", "n_words").groupBy("doc_id", "item_id")
    out = tiled.applyInPandas(tile, kinds).where(F.col("coverage") >= coverage)
    return out.withColumn("contaminated", F.lit(True))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents without a leak; those without an id are kept."""
    return docs.join(leaks(docs, benchmark, **settings).select("doc_id").distinct(), "doc_id", "left_anti").select(
        *docs.columns
    )
