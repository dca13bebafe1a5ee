"""Base and derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, name: str, format: str = "parquet", **options) -> DataFrame:
    """A table by path (parquet, orc), by catalog name (``format='table'``) or over JDBC.

    For JDBC pass url, and partitionColumn, lowerBound, upperBound, numPartitions so that the
    executors read key ranges in parallel; ``name`` is the remote table.
    """
    if format == "table":
        return spark.table(name)
    reader = spark.read.format(format).options(**options)
    if format == "jdbc":
        return reader.option("dbtable", name).load()
    return reader.load(name)


def read_study_table(spark: SparkSession, name: str, format: str = "parquet", **options) -> DataFrame:
    """The study table. Rows carry no order: every operator that needs one (case ascending,
    timepoint descending) states it in its own window or aggregate."""
    return read_table(spark, name, format, **options)


def replace_table(df: DataFrame, name: str, format: str = "parquet") -> DataFrame:
    """Drop and rewrite a derived table, and read it back; it also cuts the lineage."""
    if format == "table":
        df.write.mode("overwrite").saveAsTable(name)
        return df.sparkSession.table(name)
    df.write.mode("overwrite").format(format).save(name)
    return df.sparkSession.read.schema(_stored(df.schema)).format(format).load(name)


def _stored(schema: T.StructType) -> T.StructType:
    """Files hold no NOT NULL constraints."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def forced_validation_ids(df: DataFrame, ids: DataFrame, case: str = "case") -> DataFrame:
    """0/1 ``is_forced``: whether the case is in the id table."""
    from pyspark.sql import functions as F

    wanted = ids.select(F.col(ids.columns[0]).alias(case)).distinct()
    marked = df.join(wanted.withColumn("is_forced", F.lit(1)), case, "left")
    return marked.withColumn("is_forced", F.coalesce("is_forced", F.lit(0)))
