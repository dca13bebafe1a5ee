"""Session settings the operators rely on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Hot stays, admissions or subjects are split at run time by AQE. The force flag matters:
# without it Spark keeps a hot partition whole whenever splitting it would add a shuffle
# in front of the following aggregate.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # HotSpot does not compile larger methods; above it Spark generates several smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# For joins and windows over events. Fits by Spark ML depend on where rows lie and go without them.
EVENT_SETTINGS = {
    # A task that sorts a piece several times needs some 25 times its bytes.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "12m",
    # Joins whose one side has pieces of no more than this are hashed, not sorted: a task then holds one table
    # per join instead of two sorters, each of which takes a page of memory (64 MB) however few its rows.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "12m",
    # Rows that lie by one of the join keys stay where they are and the other side comes to them.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
#: Pieces of a shuffle before AQE joins small ones to the advisory size: with fewer, pieces grow with the input.
LEAST_PIECES = 1600
#: What ``tune_events`` has replaced.
_replaced: dict[str, str | None] = {}
#: Bytes of one Arrow batch of texts; both ends hold a few of them for each running task.
TEXT_BATCH = 1 << 21


def tune(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive settings on a running session, and those of events off again."""
    while _replaced:
        key, value = _replaced.popitem()
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    for key, value in ADAPTIVE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def tune_events(spark: SparkSession) -> SparkSession:
    """``tune`` with the settings for events, which hold until ``tune`` is called again."""
    tune(spark)
    pieces = max(LEAST_PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    settings = EVENT_SETTINGS | {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(pieces)}
    for key, value in settings.items():
        _replaced[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tiltframe")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session may do without the setting; it then gets a new temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    folder = tempfile.mkdtemp(prefix="tiltframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh table location below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``new_table_path`` placed and that no later step reads."""
    if not path.startswith(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/"):
        return
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within, the session setting ``key`` is ``value``."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tune_texts(spark: SparkSession) -> SparkSession:
    """From now on, Spark sends texts and sets to Python workers by a few MB instead of ten thousand rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH))
    return spark


def text_batches(spark: SparkSession):
    """``tune_texts`` for what runs within."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH))


def short_lived_shuffles(spark: SparkSession):
    """Within, Spark deletes the shuffle files of a query as soon as it has ended, for writes of tables
    whose plans nobody runs again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
