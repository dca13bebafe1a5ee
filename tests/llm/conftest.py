import glob
import os

import duckdb
import pytest


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def frame(spark):
    """A frame of documents; extra columns have the names that operators use inside."""

    def make(rows, **more):
        kinds = "doc_id long, text string, lang string, source string, n_chars long, n long, root string, `lost` int, prefix int"
        return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "r", 2, 3) for d, t in rows], kinds)

    return make
