"""Connected components of a graph whose edges and nodes may fill many machines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.session import new_table_path


def _stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder instead of a growing plan."""
    path = new_table_path(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node in ``edges`` (a, b: long).

    Large-star and small-star steps in turn: every node hands its larger (or all its) neighbours to
    the smallest one. A step sums up neighbours into one minimum per node and joins it back, so a
    node with very many neighbours is an ordinary skewed join. The steps end when the edges are stars
    around the roots.
    """
    stars = _stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _stored(large.where("a <> b").distinct())
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small_low, "a")
        small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(small_low.select("a", F.col("m").alias("b")))
        new = _stored(small.where("a <> b").distinct())
        same = new.exceptAll(stars).isEmpty() and stars.exceptAll(new).isEmpty()
        stars = new
        if same:
            break
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
