"""Ordered computations over groups of any size.

A window over one key sorts the whole key in one task. Here every key is cut into chunks along
the order (a day, a range of hours, a score interval). Chunk totals are aggregated with map-side
combine, carried over the few chunk rows, and joined back, so a task only ever holds one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_carry(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    parts: dict[str, tuple[Column, Callable[[Column], Column]]],
) -> DataFrame:
    """Add, per row, values folded from all *earlier* chunks of the same key.

    ``parts`` maps an output name to (aggregate within a chunk, fold over earlier chunks).
    Every row is kept: a null chunk (an integer or a date) becomes the last one of its key, and
    rows with a null key are carried nothing.
    """
    df = df.withColumn(chunk, F.coalesce(chunk, _last_chunk(df, chunk)))
    totals = df.groupBy(*keys, chunk).agg(*[agg.alias(name) for name, (agg, _) in parts.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys, chunk, *[fold(F.col(name)).over(earlier).alias(name) for name, (_, fold) in parts.items()]
    )
    return df.join(carried, [*keys, chunk], "left")


def _last_chunk(df: DataFrame, chunk: str) -> Column:
    kind = df.schema[chunk].dataType
    if isinstance(kind, T.DateType):
        return F.lit("9999-12-31").cast(kind)
    return F.lit((1 << 31) - 1 if isinstance(kind, T.IntegerType) else (1 << 63) - 1).cast(kind)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column | str],
    value: Column,
    name: str,
    peers: bool = False,
) -> DataFrame:
    """Inclusive running sum. ``peers=True`` gives rows with equal order the same total."""
    value_col, carry = f"__{name}_value", f"__{name}_carry"
    df = with_carry(
        df.withColumn(value_col, value), keys, chunk, {carry: (F.sum(value_col), F.sum)}
    )
    frame = Window.partitionBy(*keys, chunk).orderBy(*order)
    low, now = Window.unboundedPreceding, Window.currentRow
    frame = frame.rangeBetween(low, now) if peers else frame.rowsBetween(low, now)
    total = F.sum(value_col).over(frame) + F.coalesce(F.col(carry), F.lit(0))
    return df.withColumn(name, total).drop(value_col, carry)


def row_positions(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column | str], name: str
) -> DataFrame:
    """1-based position of each row in its key; ``order`` must be complete."""
    return running_sum(df, keys, chunk, order, F.lit(1).cast("bigint"), name)


def dense_positions(
    df: DataFrame, keys: Sequence[str], order: str, chunk_of: Callable[[Column], Column], name: str
) -> DataFrame:
    """Dense rank of ``order`` inside ``keys``, a null as the last value: distinct values are numbered,
    then joined back. Rows with a null key are kept and numbered within their chunk."""
    distinct = df.select(*keys, order).distinct().withColumn("__chunk", chunk_of(F.col(order)))
    numbered = row_positions(distinct, keys, "__chunk", [order], name).drop("__chunk")
    by = {c: f"__by_{c}" for c in [*keys, order]}
    numbered = numbered.withColumnsRenamed(by).withColumn(name, F.col(name).cast("int"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(b)) for c, b in by.items()])
    return df.join(numbered, same, "left").drop(*by.values())


def global_positions(
    df: DataFrame, key: str, name: str, keys: Sequence[str] = (), chunk_rows: int = 250_000
) -> DataFrame:
    """0-based position of every row in the order of a unique integer ``key``.

    The order is cut at approximate quantiles into chunks of about ``chunk_rows`` rows, whatever the
    spread of the keys; no task sees more than one of them. Positions do not depend on the cuts.
    """
    chunks = max(1, -(-df.count() // chunk_rows))
    cuts: list[float] = []
    if chunks > 1:
        shares = [i / chunks for i in range(1, chunks)]
        found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * chunks))).first()[0]
        cuts = sorted(set(map(float, found)))
    rows = df.withColumn("__at", F.col(key).cast("double"))
    splits = [float("-inf"), *cuts, float("inf")]
    if cuts:
        rows = Bucketizer(splits=splits, inputCol="__at", outputCol="__chunk").transform(rows)
    else:
        rows = rows.withColumn("__chunk", F.lit(0))
    rows = rows.withColumn("__chunk", F.col("__chunk").cast("bigint")).drop("__at")
    out = row_positions(rows, keys, "__chunk", [key], name)
    return out.withColumn(name, F.col(name) - 1).drop("__chunk")
