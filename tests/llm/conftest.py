import glob
import os

import duckdb
import pytest
from pyspark.sql import Row

SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts: their ids are their places, unless pairs are given."""
    def make(*texts, sources=None):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", (sources or {}).get(i, "s"), None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def answers():
    """Rows of a DuckDB statement over the small tables, or over frames given by table name."""
    def run(sql, **frames):
        con = duckdb.connect()
        for path in glob.glob(f"{SMALL}/*.parquet"):
            name = os.path.basename(path)[:-8]
            if name not in frames:
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        for name, frame in frames.items():
            con.register(name, frame.toArrow())
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        return sorted((tuple(sorted(zip(names, r))) for r in got.fetchall()), key=repr)

    return run


@pytest.fixture(scope="session")
def plain():
    """Collected rows in the form of ``answers``."""
    def run(frame):
        return sorted((tuple(sorted(r.asDict().items())) for r in frame.collect()), key=repr)

    return run


@pytest.fixture
def row():
    return Row
