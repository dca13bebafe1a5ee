"""Sums of matrices over the rows of a table: one block of numbers per task, added up by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_sums(
    df: DataFrame, columns: Sequence[str], part: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum of ``part(block)`` over blocks of rows; a block has one double column per name, with
    NaN for nulls. ``part`` must be a sum over the rows of its block.

    A task adds up its blocks; the sums of the tasks are added by place, so what is shuffled and what
    reaches the driver is as large as one result, whatever the rows.
    """
    shape = part(np.zeros((0, len(columns)))).shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            block = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            total += part(np.column_stack(block))
        flat = total.ravel()
        yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sums = rows.mapInArrow(summed, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = sums.toPandas()
    out = np.zeros(shape)
    out.ravel()[found["place"].to_numpy(np.int64)] = found["value"].to_numpy()
    return out
