"""Vectors of whole numbers, dealt out in blocks of bounded size.

Components become ``floor(scale * x)``, x as double. Whole numbers beyond the range of a long count as
its ends. A vector that is null or holds a null or non-finite component takes no part; one without
components does, and its products are 0. Only vectors of one length are ever multiplied.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltframe.session import new_table_path

LONG_MAX = (1 << 63) - 1
#: Blocks are this small at least, and this large at most (components of a block are bounded too).
LEAST_BLOCK, MOST_BLOCK, MOST_COMPONENTS = 1024, 16_384, 1 << 22
#: Of rows that search, so many meet one block in one group.
SEARCHERS = 8192


def stored(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _whole(lists: pa.Array, scale: float) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which lists are vectors; those as bytes of doubles, and their lengths."""
    lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    x = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    use = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.clip(np.floor(x * scale), -(2.0**63), 2.0**63) + 0.0
    x = x[np.repeat(use, lengths)]
    offsets = np.concatenate(([0], np.cumsum(lengths[use] * 8))).astype(np.int64)
    data = pa.Array.from_buffers(pa.large_binary(), int(use.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
    return use, data.cast(pa.binary()), lengths[use]


def whole_rows(rows: DataFrame, scale: float, **more: Column) -> DataFrame:
    """Stored rows that take part: row (a number of its own), vec_id, width, vector (the bytes of its
    doubles) and the columns ``more``. Rows without an id take no part."""
    chosen = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        *(c.alias(name) for name, c in more.items()),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).where("vec_id IS NOT NULL")
    chosen = chosen.select(F.monotonically_increasing_id().alias("row"), *chosen.columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name != "vector")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use, data, lengths = _whole(batch.column(batch.num_columns - 1), scale)
            kept = batch.filter(pa.array(use))
            columns = [*kept.columns[:-1], pa.array(lengths.astype(np.int32)), data]
            yield pa.record_batch(columns, [*batch.schema.names[:-1], "width", "vector"])

    return stored(chosen.mapInArrow(packed, f"{kinds}, width int, vector binary"), "whole-vectors")


def block_size(n: int, width: int) -> int:
    """Rows of a block: 64 blocks at least, until a block has its least size."""
    return max(1, min(max(n // 64, LEAST_BLOCK), MOST_BLOCK, MOST_COMPONENTS // max(width, 1)))


def blocked(table: DataFrame, bucket: str, size: int) -> tuple[DataFrame, DataFrame]:
    """``table`` with block (from 0), which lies within one bucket and holds about ``size`` rows at most;
    and the buckets with first_block and blocks, one row for each."""
    counts = table.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(bucket, F.ceil(F.col("n") / size).cast("long").alias("blocks"))
    # One row for each bucket, which are fewer than rows by the size of a block.
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.withColumn("first_block", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("long"))
    buckets = stored(buckets, "buckets")
    at = F.pmod(F.xxhash64("row"), F.col("blocks"))
    dealt = table.join(buckets, bucket).withColumn("block", F.col("first_block") + at)
    return dealt.drop("blocks", "first_block"), buckets


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a binary column, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column) or not width:
        return np.zeros((len(column), width))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return flat.view("<f8").reshape(len(column), width)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group whole, from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(i)[at].as_py() for i in range(keys))

    for batch in itertools.chain(batches, [None]):
        if batch is None:
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            return
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(held) and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
        starts = np.flatnonzero(new).tolist()
        at = 0
        for start in starts:
            if start > at:
                held.append(batch.slice(at, start - at))
            yield pa.Table.from_batches(held).combine_chunks()
            held, at = [], start
        held.append(batch.slice(at))


def highest(values: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest values, equal ones in the order given."""
    if len(values) > 4 * k:
        enough = values >= np.partition(values, len(values) - k)[len(values) - k]
        values, places = values[enough], places[enough]
    return places[np.argsort(~values, kind="stable")[:k]]


def chunks_of(n: int) -> int:
    return max(1, -(-n // SEARCHERS))


def met(own: DataFrame, searchers: DataFrame, chunks: int, kinds: str, search) -> DataFrame:
    """``search(block rows, searching rows)`` of each block and chunk of searchers, as record batches.

    ``own`` has block, ``searchers`` have block and row; what one of them lacks of the other's columns is
    null there. A group holds one block and about ``SEARCHERS`` searchers.
    """
    copies = own.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    copies = copies.withColumn("searches", F.lit(False))
    asking = searchers.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    both = copies.unionByName(asking.withColumn("searches", F.lit(True)), allowMissingColumns=True)
    both = both.select("block", "chunk", "searches", *(c for c in both.columns if c not in ("block", "chunk", "searches")))
    both = both.repartition("block", "chunk").sortWithinPartitions("block", "chunk")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            asks = group["searches"]
            if pc.any(asks).as_py() and not pc.all(asks).as_py():
                yield from search(group.filter(pc.invert(asks)), group.filter(asks))

    return both.mapInArrow(meet, kinds)
