"""Best-fit packing with exact-complement hashing.

Documents become token pieces of at most ``size`` tokens: the ids of the text, then the end id; only
a longer document is cut, into full pieces after a first one that may be shorter. Which pieces share
a sequence depends on their lengths alone, so the plan is made from the number of pieces of each
length, at most ``size`` numbers at any input size:

1. lengths, and the sums of two and of three lengths, are indexed by their sum; from the longest
   length down, a gap that a single, a pair or a triple fills exactly is closed that way, for as
   many sequences at once as the counts of all lengths involved allow;
2. what is left is packed best-fit: each sequence takes the longest length that still fits, again
   for as many equal sequences at once as the counts allow.

A plan line is a list of lengths with a number of sequences. It uses up a length or nearly so, which
bounds the lines by a small multiple of ``size``. Pieces are then numbered within their length, in
chunks so that no task orders all pieces of one length, and the number tells the plan line, the
sequence and the offset.

Null or empty text is the end id alone. Repeated rows are packed each. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltframe.llm.text import slices
from tiltframe.llm.tokens import encoder
from tiltframe.session import new_table_path

SIZE = 1024
END_ID = 2
#: Pieces of one length are numbered in so many chunks at least, and in chunks of about CHUNK at most.
CHUNKS, CHUNK = 64, 50_000


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document. ``path`` is the
    vocabulary file, the same on every machine."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, added=True).encode
        for batch in slices(batches, 1):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, found in zip(batch.column(0).to_pylist(), code(batch.column(1)), strict=True):
                ids = found.astype("<u4").tobytes() + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(rows, (doc, i, start, length, crc), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class PlanLine:
    """``times`` sequences that each hold these lengths, in this order."""

    lengths: tuple[int, ...]
    times: int


def _times(lengths: tuple[int, ...], left: np.ndarray) -> int:
    """How many sequences of these lengths the counts allow."""
    return min(int(left[x]) // lengths.count(x) for x in set(lengths))


def _exact(gap: int, longest: int, left: np.ndarray) -> Iterator[tuple[int, ...]]:
    """The singles, pairs and triples of lengths that are left, none above ``longest``, of sum ``gap``,
    those with the longest members first. Indexed by the sum: the complement of one or two members is
    looked up among the counts."""
    if gap <= longest and left[gap] > 0:
        yield (gap,)
    for a in range(min(gap - 1, longest), (gap - 1) // 2, -1):
        if left[a] > 0 and left[gap - a] > 0:
            yield (a, gap - a)
    present = np.flatnonzero(left[: min(gap - 1, longest + 1)] > 0)
    for a in present[::-1].tolist():
        if 3 * a < gap:
            break
        rest = gap - a
        low = max(1, rest - a)
        half = np.arange(rest // 2, low - 1, -1)
        for c in half[(left[half] > 0) & (left[rest - half] > 0)].tolist():
            if rest - c <= a:
                yield (a, rest - c, c)


def plan(counts: dict[int, int], size: int = SIZE) -> list[PlanLine]:
    """Sequences for so many pieces of each length."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lines: list[PlanLine] = []

    def take(lengths: tuple[int, ...]) -> None:
        times = _times(lengths, left)
        if times:
            for x in lengths:
                left[x] -= times
            lines.append(PlanLine(lengths, times))

    take((size,))
    for length in range(size - 1, 0, -1):
        if left[length]:
            for others in _exact(size - length, length, left):
                take((length, *others))
                if not left[length]:
                    break
    while left.any():
        lengths: list[int] = []
        gap = size
        rest = left.copy()
        while gap and (fits := np.flatnonzero(rest[1 : gap + 1])).size:
            x = int(fits[-1]) + 1
            lengths.append(x)
            rest[x] -= 1
            gap -= x
        take(tuple(lengths))
    return lines


def _lookup(lines: list[PlanLine]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: the numbers at which a stretch of its pieces begins, and the sequence and the
    offset of the first piece of the stretch."""
    table: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for line in lines:
        offset = 0
        for x in line.lengths:
            begins, sequences, offsets = table.setdefault(x, ([], [], []))
            begins.append(used.get(x, 0))
            sequences.append(sequence)
            offsets.append(offset)
            used[x] = used.get(x, 0) + line.times
            offset += x
        sequence += line.times
    return table


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    path = new_table_path(spark, "pieces")
    pieces.write.parquet(path)
    pieces = spark.read.parquet(path)
    # A length has as many chunks as its number of pieces asks for, so no task orders more than about one.
    chunks = [CHUNKS] * (size + 1)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        chunks[r.length] = max(CHUNKS, -(-r.n // CHUNK))
    hashed = F.xxhash64("doc_id", "piece", "ids_crc32", "start")
    pieces = pieces.withColumn("chunk", F.pmod(hashed, F.get(F.array(*map(F.lit, chunks)), F.col("length"))))
    cells = {(r.length, r.chunk): r.n for r in pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts: dict[int, int] = {}
    bases: dict[tuple[int, int], int] = {}
    for (length, chunk_no), n in sorted(cells.items()):
        bases[length, chunk_no] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    stretches = {
        x: tuple(np.array(column, np.int64) for column in columns)
        for x, columns in _lookup(plan(counts, size)).items()
    }
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = pieces.withColumn("number", F.row_number().over(own) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            base = [bases[k] for k in zip(lengths.tolist(), batch.column("chunk").to_pylist(), strict=True)]
            numbers = batch.column("number").to_numpy() + np.array(base, np.int64)
            sequence, offset = np.empty_like(numbers), np.empty_like(numbers)
            for x in np.unique(lengths):
                begins, sequences, offsets = stretches[int(x)]
                rows = np.flatnonzero(lengths == x)
                at = np.searchsorted(begins, numbers[rows], "right") - 1
                sequence[rows] = sequences[at] + numbers[rows] - begins[at]
                offset[rows] = offsets[at]
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.record_batch(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "chunk", F.col("number").cast("long"))
    return rows.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
