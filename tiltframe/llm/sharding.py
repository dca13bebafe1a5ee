"""Sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots and stays there for good. What changes is
the slot-to-shard map, a small versioned table: a rebalance reads the bytes of each slot and writes
the next version in which some slots have moved. The law held is ``bytes``: shards of near equal
size. Records are never moved one by one, and nothing but the map (``SLOTS`` rows at any input
size) is seen by the driver.

Null text counts no bytes and has the checksum of the empty text. Rows without an id, and rows that
repeat an id, hash with their text's checksum and size, so only rows equal in all three share a slot
by force. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltframe.session import new_table_path

SLOTS = 4096
#: What a record takes in a shard besides its text.
OVERHEAD_BYTES = 8


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    spread = F.xxhash64("doc_id", "text_crc32", "size")
    return rows.withColumn("virtual_slot", F.pmod(spread, F.lit(slots)).cast("int"))


def slot_totals(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot in use; at most as many rows as there are slots."""
    return records.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def even_map(slots: int, shards: int) -> list[int]:
    """The first version of a map, which knows no sizes."""
    return [slot % shards for slot in range(slots)]


def rebalanced(current: Sequence[int], sizes: Sequence[int], shards: int) -> list[int]:
    """An edited map: slots move from the fullest shard to others, or trade places with a smaller
    one there, as long as this brings the two closer. Empty slots stay where they are."""
    new = list(current)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(new):
        if sizes[slot]:
            held[shard].append((sizes[slot], slot))
    for rows in held:
        rows.sort()
    total = [sum(s for s, _ in rows) for rows in held]
    for _ in range(16 * len(new)):
        full = max(range(shards), key=lambda s: (total[s], s))
        best = None
        for other in sorted(range(shards), key=lambda s: (total[s], s)):
            gap = total[full] - total[other]
            if other == full or gap < 2:
                break
            for size, slot in held[full]:
                want = size - gap / 2
                at = bisect_left(held[other], (want, -1))
                for near in (None, *held[other][max(0, at - 1) : at + 1]):
                    moved = size - (near[0] if near else 0)
                    if 0 < moved < gap:
                        left = max(total[full] - moved, total[other] + moved)
                        if best is None or left < best[0]:
                            best = (left, other, (size, slot), near)
            if best is not None:
                break
        if best is None:
            break
        _, other, item, near = best
        held[full].remove(item)
        held[other].insert(bisect_left(held[other], item), item)
        new[item[1]] = other
        moved = item[0]
        if near is not None:
            held[other].remove(near)
            held[full].insert(bisect_left(held[full], near), near)
            new[near[1]] = full
            moved -= near[0]
        total[full] -= moved
        total[other] += moved
    return new


def write_map(spark: SparkSession, path: str, version: int, shard_of: Sequence[int]) -> None:
    """Store one version of the map as the partition ``version`` of the table at ``path``."""
    shards = F.split(F.lit(",".join(map(str, shard_of))), ",")
    spark.range(len(shard_of)).select(
        F.col("id").cast("int").alias("virtual_slot"),
        F.get(shards, F.col("id").cast("int")).cast("int").alias("shard"),
    ).coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """virtual_slot and shard of one version, the latest by default."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version).drop("version")


def shard_by_bytes(
    docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None
) -> DataFrame:
    """Every record with its shard and its place there.

    doc_id, size, text_crc32, law, shard, slot (the place in the shard, from 0 without gaps),
    grown_shard (null: another shard count edits the map by bytes), virtual_slot. The place is the
    rows of the shard's earlier virtual slots plus the place in the own one, so no window is wider
    than one virtual slot.
    """
    spark = docs.sparkSession
    path = new_table_path(spark, "slotted")
    slotted(docs, slots).write.parquet(path)
    records = spark.read.parquet(path)
    totals = slot_totals(records)
    sizes = [0] * slots
    for row in totals.collect():
        sizes[row.virtual_slot] = row.bytes
    map_path = map_path or new_table_path(spark, "slot-map")
    first = even_map(slots, shards)
    write_map(spark, map_path, 1, first)
    write_map(spark, map_path, 2, rebalanced(first, sizes, shards))

    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        read_map(spark, map_path)
        .join(totals, "virtual_slot")
        .select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("place", F.row_number().over(within) - 1)
    return placed.join(bases, "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
