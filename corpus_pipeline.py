"""The corpus pipeline: toxic documents go, shared lines go, one document of each group of near copies
stays, documents with benchmark passages go, and the rest is packed into sequences.

Every stage takes the frame of documents that the one before has kept. The first four return the
columns of documents, with ``n_chars`` following the text; the last returns one row per packed piece.
Rows without an id pass the first four stages and are packed. Run as a whole, each stage is written
below the shared folder and read again, so no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltframe.llm import decontaminate, jaccard, linededup, packing, toxicity
from tiltframe.llm.queries import byte_bpe
from tiltframe.session import new_table_path, tune_texts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, chain)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = linededup.indexed(docs, new_table_path(spark, "line-index"))
    kept = index.deduplicated(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, k=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, byte_bpe()))


def _bounded(stage):
    """Workers keep what their largest batch took; the frame that a stage returns runs after it."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tune_texts(spark), docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _bounded(drop_toxic)),
    ("line_dedup", _bounded(drop_shared_lines)),
    ("ngram_jaccard_join", _bounded(drop_near_copies)),
    ("benchmark_decontamination", _bounded(drop_benchmark_leaks)),
    ("best_fit_packing", _bounded(pack)),
]

#: No SQL states a fitted classifier or the packing; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
