import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from keystride.plans.oracle import ORACLE
from keystride.plans.queries import QUERIES
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["prefix", "rank", "query", "count", "score", "blended"]


@pytest.mark.parametrize("name", [
    "dictionary", "all_prefix_topk", "prefix_recency", "prefix_recency_old", "trending_recency_old", "suggest_batch", "trending_recency", "trending_cold_start", "trending_snapshots",
    "flush_fold", "requeue_merge", "upsert_merge", "parse_lines", "materialized_else_compute", "ttl_refresh",
    "lists_after_changes", "upsert_ranges", "ring_assign", "debounce", "latency_percentiles", "debounce_large", "latency_large", "ttl_large", "stream_score",
])
def test_equals_sql(spark, name):
    """A selection; ``tools/check.py`` runs them all."""
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert compare(spark, con, FOLDER, name).startswith("equal")
