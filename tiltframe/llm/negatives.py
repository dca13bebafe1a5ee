"""Hard negatives by exact integer products in a residue number system.

The components are whole numbers (see ``integers``). A block of anchors meets a block of rows in one
float32 matrix product per prime: components are reduced modulo the largest primes under 1,024 to their
residues of least size, so that a sum of ``SLICE`` products stays within the 24 bits in which float32 is
exact. Chinese remaindering (Garner's mixed radix digits) gives the signed products back; there are as
many primes as the largest components of the two blocks can need, so the scores are exact.

1. Rows are dealt into blocks by label; a label of very many rows has many blocks, rare labels share one.
   Each anchor meets the blocks of its label; the best few of each block, then of all, are its positives.
2. Each anchor, with the scores of its positives, meets all blocks. For each positive, the best few rows
   of other labels within the window of scores are kept per block, then over all.

Scores order rows from high to low, equal ones by smaller vec_id. Rows with a null id or label, a null
vector, or any null or non-finite component take no part. Vectors of other lengths than the anchor's are
no partners of it. Rows that repeat an id are rows of their own: an anchor's other rows may have its id.
A score beyond the range of a long counts as that range's end. An anchor without positives, or a positive
without negatives, gives no rows, as does an empty table. Further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltframe.llm.integers import LONG_MAX, block_size, blocked, chunks_of, highest, matrix, met, stored, whole_rows

#: Components whose products are summed up in float32: SLICE * 511 ** 2 < 2 ** 24.
SLICE = 64
#: Anchors of one matrix product.
TILE = 256


@functools.cache
def primes() -> list[int]:
    """The primes under 1,024, from the largest down to 513: each adds nine bits and more."""
    return [n for n in range(1023, 512, -2) if all(n % d for d in range(3, 32, 2))]


def enough(bound: int) -> list[int]:
    """So many primes that products within ``bound`` of 0 fill no more than half of their residues."""
    chosen, product = [], 1
    for p in primes():
        if product > 4 * bound:
            break
        chosen.append(p)
        product *= p
    return chosen or primes()[:1]


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo p, between -p/2 and p/2."""
    r = np.fmod(x, p)
    r[r > p // 2] -= p
    r[r < -(p // 2)] += p
    return r.astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """The products of two matrices of residues, row by row, modulo p."""
    total = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], SLICE):
        part = a[:, at : at + SLICE] @ b[:, at : at + SLICE].T
        total = (total + part.astype(np.int32)) % p
    return total


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of the rows of two matrices of whole numbers, at the range of a long at most."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    chosen = enough(bound)
    digits: list[np.ndarray] = []
    for i, p in enumerate(chosen):
        digit = residue_product(residues(a, p), residues(b, p), p)
        for q, known in zip(chosen[:i], digits, strict=True):
            digit = (digit - known) * pow(q, -1, p) % p
        digits.append(digit)
    if bound >= 1 << 61:
        return _long_scores(digits, chosen)
    value = np.zeros(digits[0].shape, np.uint64)
    size = np.zeros(digits[0].shape)
    weight = 1
    for digit, p in zip(digits, chosen, strict=True):
        value += digit.astype(np.uint64) * np.uint64(weight % (1 << 64))
        size += digit * float(weight)
        weight *= p
    # No product lies near the middle of the range, so doubles tell the two halves.
    value[size > weight / 2] -= np.uint64(weight % (1 << 64))
    return value.view(np.int64)


def _long_scores(digits: list[np.ndarray], chosen: list[int]) -> np.ndarray:
    value = np.zeros(digits[0].shape, object)
    weight = 1
    for digit, p in zip(digits, chosen, strict=True):
        value = value + digit.astype(object) * weight
        weight *= p
    value = np.where(value > weight // 2, value - weight, value)
    return np.clip(value, -LONG_MAX - 1, LONG_MAX).astype(np.int64)


def _tiles(block: pa.Table, asking: pa.Table):
    """The scores of each tile of anchors, with the places of anchors and rows; rows are by id."""
    widths, own_widths = asking["width"].to_numpy(), block["width"].to_numpy()
    order = np.lexsort((block["row"].to_numpy(), block["vec_id"].to_numpy()))
    for width in np.unique(widths).tolist():
        there, here = np.flatnonzero(widths == width), order[own_widths[order] == width]
        if not len(here):
            continue
        b = matrix(block["vector"].take(pa.array(here)), width)
        for at in range(0, len(there), TILE):
            tile = there[at : at + TILE]
            yield scores(matrix(asking["vector"].take(pa.array(tile)), width), b), tile, here


def positives(table: DataFrame, buckets: DataFrame, k: int, chunks: int) -> DataFrame:
    """row (of the anchor), place (from 0), vec_id and score of the first k other rows of its label."""

    def search(block: pa.Table, asking: pa.Table) -> Iterator[pa.RecordBatch]:
        labels, own = asking["label"].to_numpy(), block["label"].to_numpy()
        rows, own_rows, ids = asking["row"].to_numpy(), block["row"].to_numpy(), block["vec_id"].to_numpy()
        out = []
        for s, tile, here in _tiles(block, asking):
            for i, a in enumerate(tile.tolist()):
                other = np.flatnonzero((own[here] == labels[a]) & (own_rows[here] != rows[a]))
                best = highest(s[i, other], other, k)
                out.append((np.full(len(best), rows[a]), own_rows[here[best]], ids[here[best]], s[i, best]))
        if out:
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.record_batch(columns, ["row", "other", "vec_id", "score"])

    asking = table.where("anchor").drop("block").join(buckets, "bucket")
    last = F.col("first_block") + F.col("blocks") - 1
    asking = asking.withColumn("block", F.explode(F.sequence("first_block", last))).drop("first_block", "blocks")
    found = met(table, asking, chunks, "row long, other long, vec_id long, score long", search)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    found = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)
    return stored(found.drop("other"), "positives")


def hard_negatives(
    rows: DataFrame, anchors: Column, scale: float = 256, n_positives: int = 5, n_negatives: int = 5, least: int = 80
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of
    ``anchors`` and each of its positives, the first ``n_negatives`` rows of other labels whose score is
    between ``least`` per cent of the positive's and the positive's."""
    table = whole_rows(rows, scale, label=F.col("label").cast("long"), anchor=F.coalesce(anchors, F.lit(False)))
    table = table.where("label IS NOT NULL")
    facts = table.agg(F.count(F.lit(1)), F.max("width"), F.count_if("anchor")).first()
    n, width, n_anchors = facts[0], facts[1] or 0, facts[2]
    size, chunks = block_size(n, width), chunks_of(n_anchors)
    many = max(1, -(-n // size))
    table = table.withColumn("bucket", F.pmod(F.xxhash64("label", "width"), F.lit(many)))
    table, buckets = blocked(table, "bucket", size)
    table = stored(table, "label-blocks")
    n_blocks = buckets.agg(F.sum("blocks")).first()[0] or 1
    plus = positives(table, buckets, n_positives, chunks)
    lists = plus.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("plus"))
    lists = lists.select("row", F.col("plus.vec_id").alias("plus_ids"), F.col("plus.score").alias("plus_scores"))

    def search(block: pa.Table, asking: pa.Table) -> Iterator[pa.RecordBatch]:
        labels, own = asking["label"].to_numpy(), block["label"].to_numpy()
        found, ids = asking["row"].to_numpy(), block["vec_id"].to_numpy()
        wanted = asking["plus_scores"].to_pylist()
        out = []
        for s, tile, here in _tiles(block, asking):
            for i, a in enumerate(tile.tolist()):
                high, low = max(wanted[a]), min(-(-least * w // 100) for w in wanted[a])
                near = np.flatnonzero((s[i] >= low) & (s[i] <= high) & (own[here] != labels[a]))
                if not len(near):
                    continue
                values = s[i, near]
                for place, w in enumerate(wanted[a]):
                    fits = (values <= w) & (values >= -(-least * w // 100))
                    best = highest(values[fits], near[fits], n_negatives)
                    where = np.full(len(best), place)
                    out.append((np.full(len(best), found[a]), where, ids[here[best]], s[i, best]))
        if out:
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)]
            yield pa.record_batch(columns, ["row", "place", "negative_id", "negative_score"])

    asking = table.where("anchor").drop("block", "bucket").join(lists, "row")
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    minus = met(table.drop("bucket", "anchor"), asking.drop("anchor"), chunks, "row long, place long, negative_id long, negative_score long", search)
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    minus = minus.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    named = plus.join(table.where("anchor").select("row", F.col("vec_id").alias("anchor_id")), "row")
    named = named.select(
        "row", "anchor_id", F.col("place").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return minus.join(named, ["row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
