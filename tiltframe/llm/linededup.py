"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without the ASCII white space at its ends, A-Z lower-cased. Of a key of at
least ``MIN_CHARS`` code points that is found in two documents or more, every line goes except those
in the document of the smallest id. Shorter keys and all other lines stay, joined by ``\\n``.

``LineIndex`` keeps, below one shared folder, generations of three tables:

* ``postings`` (shard, key, doc_id): which documents hold which key;
* ``references`` (shard, key, refs, first_doc): the exact count and the smallest id;
* ``filters`` (shard, filter): a cuckoo filter of the shard's keys.

An insertion asks the filters first: a key that its filter does not know is new for certain and gets
its reference row without a lookup; only the others meet the reference table. A deletion takes the
documents' postings out, recounts the keys that they held, and removes from the filters the keys that
no document holds any longer, so that deleting what was inserted restores the former answers. Each
change writes a new generation and leaves the one before as it was; a failed job changes nothing.

Null or empty text is one empty line. Rows without an id neither count nor lose lines. Rows that
repeat an id count as one document. An empty table gives an empty index and no rows. Further columns
of the documents are returned as they are by ``deduplicated``, but for those that are named n_lines or
n_dropped, whose place the new columns take.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltframe.llm.cuckoo import CuckooFilter
from tiltframe.llm.text import slices

MIN_CHARS = 10
#: Keys that one shard's filter is made for.
SHARD_KEYS = 1 << 17
#: Insertions by which ``indexed`` builds an index; each writes the tables anew.
BATCHES = 2

_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16 bytes that stand for the line's key, or None if the key is too short."""
    key = line.strip(_SPACE).translate(_LOWER)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x or b"" for x in column.cast(pa.large_binary()).to_pylist())


def line_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key and doc_id of every key of every document with an id, each once per row of documents."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                own = {line_key(line, min_chars) for line in text.split(b"\n")}
                own.discard(None)
                keys.extend(own)
                ids.extend([doc] * len(own))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(found, "key binary, doc_id long")


class LineIndex:
    """The index below ``path``. ``shards`` is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, shards: int, min_chars: int = MIN_CHARS):
        self.spark, self.path, self.shards, self.min_chars = spark, path, shards, min_chars
        self.generation = 0

    def _at(self, table: str, generation: int | None = None) -> str:
        g = self.generation if generation is None else generation
        return f"{self.path}/generation={g}/{table}"

    def _read(self, table: str, kind: str) -> DataFrame:
        if not self.generation:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(self._at(table))

    def postings(self) -> DataFrame:
        return self._read("postings", "shard int, key binary, doc_id long")

    def references(self) -> DataFrame:
        return self._read("references", "shard int, key binary, refs long, first_doc long")

    def filters(self) -> DataFrame:
        return self._read("filters", "shard int, filter binary")

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _changed_filters(self, keys: DataFrame, kind: str) -> DataFrame:
        """Per shard its filter with the rows of ``keys`` (shard, key) added or removed."""

        def change(key, held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            marks = np.array([int.from_bytes(k[:8], "little") for k in own["key"]], np.uint64)
            if len(held):
                cuckoo = CuckooFilter.from_bytes(held["filter"].iloc[0])
            else:
                cuckoo = CuckooFilter.for_keys(max(2 * len(own), 1024))
            cuckoo.remove(marks) if kind == "remove" else cuckoo.add(marks)
            return pd.DataFrame({"shard": [key[0]], "filter": [cuckoo.to_bytes()]})

        held = self.filters().groupBy("shard")
        return held.cogroup(keys.groupBy("shard")).applyInPandas(change, "shard int, filter binary")

    def _maybe_known(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``maybe``: false if the shard's filter proves that the key is new."""

        def probe(key, held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            marks = np.array([int.from_bytes(k[:8], "little") for k in own["key"]], np.uint64)
            if len(held):
                own["maybe"] = CuckooFilter.from_bytes(held["filter"].iloc[0]).contains(marks)
            else:
                own["maybe"] = False
            return own[["shard", "key", "refs", "first_doc", "maybe"]]

        held = self.filters().groupBy("shard")
        return held.cogroup(keys.groupBy("shard")).applyInPandas(
            probe, "shard int, key binary, refs long, first_doc long, maybe boolean"
        )

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; one that is held already gets the union of its lines."""
        new = line_postings(docs, self.min_chars).withColumn("shard", self._shard())
        new = new.select("shard", "key", "doc_id").distinct()
        after = self.generation + 1
        if not self.generation:
            new.write.parquet(self._at("postings", after))
            fresh = self.spark.read.parquet(self._at("postings", after))
        else:
            fresh = new.join(self.postings(), ["shard", "key", "doc_id"], "left_anti")
            fresh.write.parquet(self._at("added", after))
            fresh = self.spark.read.parquet(self._at("added", after))
            self.postings().unionByName(fresh).write.parquet(self._at("postings", after))
        counts = fresh.groupBy("shard", "key").agg(
            F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc")
        )
        if not self.generation:
            counts.write.parquet(self._at("references", after))
            added = self.spark.read.parquet(self._at("references", after))
        else:
            self._maybe_known(counts).write.parquet(self._at("probed", after))
            probed = self.spark.read.parquet(self._at("probed", after))
            asked = probed.where("maybe").select("shard", "key", "refs", "first_doc")
            met = asked.join(self.references().select("key", F.col("refs").alias("old_refs")), "key", "left")
            merged = self.references().unionByName(asked).groupBy("shard", "key").agg(
                F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc")
            )
            sure = probed.where("NOT maybe").select("shard", "key", "refs", "first_doc")
            merged.unionByName(sure).write.parquet(self._at("references", after))
            unmet = met.where("old_refs IS NULL").select("shard", "key")
            added = sure.select("shard", "key").unionByName(unmet)
        self._changed_filters(added.select("shard", "key"), "add").write.parquet(self._at("filters", after))
        self.generation = after
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents out again; ids that are not held are ignored."""
        after = self.generation + 1
        gone_ids = doc_ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
        postings = self.postings()
        postings.join(gone_ids, "doc_id", "left_anti").select("shard", "key", "doc_id").write.parquet(
            self._at("postings", after)
        )
        touched = postings.join(gone_ids, "doc_id", "left_semi").select("key").distinct()
        left = self.spark.read.parquet(self._at("postings", after)).join(touched, "key", "left_semi")
        recounted = left.groupBy("shard", "key").agg(
            F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc")
        )
        kept = self.references().join(touched, "key", "left_anti").select("shard", "key", "refs", "first_doc")
        kept.unionByName(recounted).write.parquet(self._at("references", after))
        now = self.spark.read.parquet(self._at("references", after))
        dead = self.references().join(now.select("key"), "key", "left_anti").select("shard", "key")
        self._changed_filters(dead, "remove").write.parquet(self._at("filters", after))
        self.generation = after
        return self

    def drops(self) -> DataFrame:
        """doc_id and the sorted array of the keys whose lines it loses. A document's array is no
        longer than its own lines."""
        shared = self.references().where("refs > 1").select("key", "first_doc")
        lost = self.postings().join(shared, "key").where("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("lost"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``text`` replaced by the kept text, and n_lines and n_dropped."""
        return self._kept(docs, "text string", lambda texts: texts)

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 for every row of documents."""
        only = docs.select("doc_id", "text")
        out = self._kept(only, "kept_sha256 string", lambda texts: [hashlib.sha256(t).hexdigest() for t in texts])
        return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")

    def _kept(self, docs: DataFrame, result: str, finish) -> DataFrame:
        others = [f for f in docs.schema if f.name not in ("text", "n_lines", "n_dropped")]
        # Clashing names are carried under numbers.
        carried = docs.select(
            *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)),
            F.col("doc_id").cast("long").alias("lost_doc"),
            F.col("text").cast("string").alias("text"),
        )
        joined = carried.join(self.drops().withColumnRenamed("doc_id", "lost_doc"), "lost_doc", "left")
        names = [f"c{i}" for i in range(len(others))]
        min_chars = self.min_chars

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, len(names)):
                kept, totals, dropped = [], [], []
                lost = batch.column(batch.schema.get_field_index("lost")).to_pylist()
                for text, gone in zip(_texts(batch.column(batch.schema.get_field_index("text"))), lost, strict=True):
                    lines = text.split(b"\n")
                    totals.append(len(lines))
                    if gone:
                        gone = set(gone)
                        lines = [x for x in lines if line_key(x, min_chars) not in gone]
                        text = b"\n".join(lines)
                    dropped.append(totals[-1] - len(lines))
                    kept.append(text)
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                done = pa.array(finish(kept))
                columns += [done.cast(pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.record_batch(columns, [*names, result.split()[0], "n_lines", "n_dropped"])

        kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, others, strict=True)]
        kinds += [result, "n_lines long", "n_dropped long"]
        out = joined.select(*names, "text", "lost").mapInArrow(keep, ", ".join(kinds))
        return out.select(
            *(F.col(n).alias(f.name) for n, f in zip(names, others, strict=True)),
            result.split()[0],
            "n_lines",
            "n_dropped",
        )


def indexed(docs: DataFrame, path: str, batches: int = BATCHES) -> LineIndex:
    """An index of all documents, inserted in batches by a hash of their ids: the keys of every batch but
    the first meet the filters, and only those that these may know meet the reference table."""
    index = LineIndex(docs.sparkSession, path, shard_count(docs))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for i in range(batches):
        index.insert(docs.where(part == i))
    return index


def shard_count(docs: DataFrame, lines_per_doc: int = 16) -> int:
    """Shards for an index that begins with these documents, from their number alone."""
    return max(1, -(-docs.count() * lines_per_doc // SHARD_KEYS))
