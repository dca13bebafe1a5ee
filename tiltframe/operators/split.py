"""Disjoint train/validation split by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_hash(case: Column | str, seed: int) -> Column:
    """A 32-bit number from (seed, case), the same in any SQL engine that has md5."""
    case = F.col(case) if isinstance(case, str) else case
    digest = F.md5(F.concat(F.lit(f"{seed}:"), case.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def with_split(
    df: DataFrame,
    case: str = "case",
    test_size: float = 0.2,
    seed: int = 7,
    forced_valid: DataFrame | None = None,
    name: str = "is_valid",
) -> DataFrame:
    """Add 0/1 ``is_valid``: the first int(n * test_size) cases in hash order, and every case
    listed in ``forced_valid`` (a one-column table of ids).

    The cut is found from a histogram of the hash: at most 65,536 counts, then the cases of one
    histogram cell, are looked at; the table itself is never sorted.
    """
    cases = df.select(F.col(case).alias("__case")).distinct()
    hashed = cases.select("__case", case_hash("__case", seed).alias("__hash"))
    cells = hashed.groupBy(F.shiftrightunsigned("__hash", 16).alias("cell")).agg(
        F.count("*").alias("n")
    )
    found = [(r["cell"], r["n"]) for r in cells.collect()]  # at most 65,537 pairs
    if any(cell is None for cell, _ in found):
        raise ValueError(f"{case} is null in some rows; they belong to neither side of a split")
    counts = sorted(found)
    wanted = int(sum(n for _, n in counts) * test_size)
    upto, edge = 0, None
    for cell, n in counts:
        if upto < wanted <= upto + n:
            edge = cell
            break
        upto += n
    case_col = F.col(case)
    hash_col = case_hash(case, seed)
    if edge is None:
        chosen = F.lit(False)
    else:
        inside = hashed.where(F.shiftrightunsigned("__hash", 16) == edge)
        last = inside.orderBy("__hash", "__case").limit(wanted - upto)
        last = last.agg(F.max(F.struct("__hash", "__case")).alias("m")).first()["m"]
        chosen = (hash_col < last["__hash"]) | (
            (hash_col == last["__hash"]) & (case_col <= F.lit(last["__case"]))
        )
    out = df.withColumn(name, chosen.cast("int"))
    if forced_valid is not None:
        ids = forced_valid.select(F.col(forced_valid.columns[0]).alias(case)).distinct()
        ids = ids.withColumn("__forced", F.lit(1))
        out = out.join(ids, case, "left")
        out = out.withColumn(name, F.coalesce("__forced", F.col(name))).drop("__forced")
    return out


def split_by_case(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(train, validation)."""
    marked = with_split(df, **kw)
    name = kw.get("name", "is_valid")
    return (
        marked.where(F.col(name) == 0).drop(name),
        marked.where(F.col(name) == 1).drop(name),
    )
