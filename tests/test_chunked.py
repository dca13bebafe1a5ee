import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tiltframe.functions.chunked import dense_positions, global_positions, row_positions, running_sum
from tiltframe.operators.split import with_split


def skewed(spark, n=3000):
    """A third of the rows share one key, with repeated order values."""
    rng = random.Random(5)
    rows = [
        (0 if i % 3 == 0 else rng.randint(1, 40), rng.randint(0, 200), i, rng.randint(-5, 5))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k int, t int, id int, v int").withColumn(
        "chunk", F.floor(F.col("t") / 16)
    )


def test_running_sums_equal_one_window_per_key(spark):
    df = skewed(spark)
    by_row = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    by_peer = Window.partitionBy("k").orderBy("t")
    expected = df.select("id", F.sum("v").over(by_row).alias("a"), F.sum("v").over(by_peer).alias("b"),
                         F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).alias("p"))
    got = running_sum(df, ["k"], "chunk", ["t", "id"], F.col("v"), "a")
    got = running_sum(got, ["k"], "chunk", ["t"], F.col("v"), "b", peers=True)
    got = row_positions(got, ["k"], "chunk", ["t", "id"], "p").select("id", "a", "b", "p")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_dense_positions(spark):
    df = skewed(spark)
    expected = df.select("id", F.dense_rank().over(Window.partitionBy("k").orderBy("t")).alias("p"))
    got = dense_positions(df, ["k"], "t", lambda c: F.floor(c / 16), "p").select("id", "p")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_global_positions(spark):
    keys = random.Random(1).sample(range(-(10**9), 10**9), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = dict(map(tuple, global_positions(df, "k", "p", chunk_rows=9).select("k", "p").collect()))
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_split_is_exact_disjoint_and_independent_of_the_layout(spark):
    df = spark.range(1003).select(F.col("id").alias("case"), (F.col("id") % 3).alias("x"))
    df = df.unionByName(df)  # several rows per case
    one = {r["case"]: r["is_valid"] for r in with_split(df, test_size=0.2).collect()}
    two = {r["case"]: r["is_valid"] for r in with_split(df.repartition(13), test_size=0.2).collect()}
    other = {r["case"]: r["is_valid"] for r in with_split(df, test_size=0.2, seed=8).collect()}
    assert one == two and one != other
    assert sum(one.values()) == int(1003 * 0.2)
    forced = spark.createDataFrame([(c,) for c in (1, 2, 3, 5000)], "id bigint")
    marked = {r["case"]: r["is_valid"] for r in with_split(df, forced_valid=forced).collect()}
    assert all(marked[c] == 1 for c in (1, 2, 3)) and 5000 not in marked
    assert with_split(df, test_size=0.0).agg(F.sum("is_valid")).first()[0] == 0


def test_no_row_is_lost_to_nulls(spark):
    rows = [(1, 5, 1), (1, None, 2), (1, 40, 4), (None, 5, 8), (None, None, 16)]
    df = spark.createDataFrame(rows, "k int, t int, v int").withColumn("chunk", F.floor(F.col("t") / 16))
    got = running_sum(df, ["k"], "chunk", ["t"], F.col("v"), "a").where("k = 1").select("t", "a").collect()
    assert set(map(tuple, got)) == {(5, 1), (40, 5), (None, 7)}
    assert running_sum(df, ["k"], "chunk", ["t"], F.col("v"), "a").count() == 5
    got = dense_positions(df, ["k"], "t", lambda c: F.floor(c / 16), "p")
    assert got.count() == 5
    assert {(r.t, r.p) for r in got.where("k = 1").collect()} == {(5, 1), (40, 2), (None, 3)}


def test_one_outlying_key_does_not_fill_a_chunk(spark):
    df = spark.range(4000).selectExpr("if(id = 0, 1L << 60, id) AS k")
    got = global_positions(df, "k", "p", chunk_rows=100).orderBy("k").collect()
    assert [r.p for r in got] == list(range(4000))
