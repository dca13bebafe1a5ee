"""A bitmap of fixed size that tells which hashes a table may hold.

It is the only thing about a table that is sent to every task: ``BITS`` bits at any size of the
table. A set bit means "maybe"; an exact join follows. If the table outgrows it, more rows reach that
join, and the result is the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def hash_bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes, as ``BITS / 64`` words; each word is put together by
    Spark, so at most that many rows reach the driver."""
    place = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words = hashes.where(F.col(column).isNotNull()).select(
        F.shiftright(place, 6).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, cast(`{column}` & 63 AS INT))").alias("bit"),
    )
    out = np.zeros(BITS // 64, np.int64)
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(BITS - 1)
    word = bitmap[(place >> np.uint64(6)).astype(np.int64)]
    return (word >> (place & np.uint64(63))) & np.uint64(1) == 1
