import json

import pytest
from pyspark.sql import functions as F

from keystride.operators import prefix, ring, serving

NOW = "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def now():
    return F.lit(NOW).cast("timestamp")


@pytest.fixture(scope="module")
def world(spark, now):
    rows = [("iPhone", 50), ("ipad", 70), ("ipod", 60), ("java", 10), ("jazz", 12)]
    table = spark.createDataFrame(rows, "query string, count long").withColumn("query_norm", F.lower("query"))
    scores = spark.createDataFrame([("iphone", 9.0)], "query_norm string, score double")
    arcs = ring.build_arcs(ring.build_ring(ring.nodes_from_spec(spark, "a:1,b:2")))
    stored = serving.materialize_lists(prefix.all_prefix_top(table, 1, 2), arcs, now)
    return table, scores, stored


def test_stored_lists(world, spark, tmp_path):
    _, _, stored = world
    got = {r.cache_key: r for r in stored.collect()}
    assert got["suggest:ip"].value == '[{"query":"ipad","count":70}]'
    assert (got["suggest:ip"].expires_at.minute, got["suggest:ip"].node[:5]) == (1, "node-")
    serving.write_lists(stored, str(tmp_path / "lists"))
    assert spark.read.parquet(str(tmp_path / "lists")).count() == stored.count()


def test_requests_use_stored_lists_while_fresh(world, spark, now):
    table, scores, stored = world
    asked = spark.createDataFrame([
        (1, " IP", None), (2, "ipo", None), (3, "", "recency"), (4, "ip", "Recency"), (5, "zz", "x"), (6, None, None), (7, "ip", ""),
    ], "id long, q string, mode string")
    got = {r.id: r for r in serving.answer(asked, stored, table, scores, now).collect()}
    assert {i: r.source for i, r in got.items()} == {
        1: "MATERIALIZED", 2: "COMPUTED", 3: "EMPTY", 4: "COMPUTED", 5: "COMPUTED", 6: "EMPTY", 7: "MATERIALIZED"}
    texts = {i: [x["query"] for x in json.loads(r.value)] for i, r in got.items()}
    assert texts == {1: ["ipad"], 2: ["ipod"], 3: [], 4: ["iPhone", "ipad", "ipod"], 5: [], 6: [], 7: ["ipad"]}
    late = F.lit("2024-01-01 00:01:00").cast("timestamp")
    expired = {r.id: r.source for r in serving.answer(asked, stored, table, scores, late).collect()}
    assert expired[1] == "COMPUTED"


def test_recency_lists_expire_sooner(world, spark, now):
    table, scores, _ = world
    arcs = ring.build_arcs(ring.build_ring(ring.nodes_from_spec(spark, "a:1")))
    lists = serving.materialize_lists(prefix.all_prefix_recency(table, scores), arcs, now, "RECENCY")
    row = lists.where("cache_key = 'suggest:recency:ip'").first()
    assert row.expires_at.second == 15 and json.loads(row.value)[0] == {"query": "iPhone", "count": 50}


def test_changed_queries_invalidate_their_prefixes(world, spark):
    _, _, stored = world
    changed = spark.createDataFrame([("java",), ("java",)], "query_norm string")
    left = {r.cache_key for r in serving.invalidate(stored, changed).collect()}
    assert left == {"suggest:i", "suggest:ip"}


def test_requests_are_not_shuffled_by_their_keys(world, spark, now):
    table, scores, stored = world
    asked = spark.createDataFrame([(i, "ip", None) for i in range(50)], "id long, q string, mode string")
    plan = serving.answer(asked, stored, table, scores, now)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_batch_of_suggestions_names_source_and_node(world, spark):
    table, scores, _ = world
    arcs = ring.build_arcs(ring.build_ring(ring.nodes_from_spec(spark, "a:1,b:2")))
    asked = spark.createDataFrame([(1, "IP", None), (2, "ip", "recency"), (3, " ", None), (4, "zz", None)], "id long, q string, mode string")
    got = {r.id: r for r in serving.suggest_batch(asked, table, scores, arcs).collect()}
    assert {i: r.source for i, r in got.items()} == {1: "DB", 2: "DB+RECENCY", 3: "EMPTY", 4: "DB"}
    assert got[3].node is None and all(got[i].node.startswith("node-") for i in (1, 2, 4))
    assert json.loads(got[2].value)[0]["query"] == "iPhone" and got[4].value == "[]"


def test_one_request_names_its_node_and_a_blank_one_is_empty(world, spark):
    table, scores, _ = world
    arcs = ring.build_arcs(ring.build_ring(ring.nodes_from_spec(spark, "a:1,b:2")))
    row = serving.suggest_one(table, scores, arcs, " IP", "Recency", k=2).first()
    assert (row.prefix, row.mode, row.source) == ("ip", "RECENCY", "DB+RECENCY") and row.node.startswith("node-")
    assert [x["query"] for x in json.loads(row.value)] == [r.query for r in prefix.suggest(table, scores, "ip", "recency", k=2).orderBy("rank").collect()]
    for blank in (" \t", None):
        row = serving.suggest_one(table, scores, arcs, blank).first()
        assert (row.prefix, row.source, row.node, row.value) == ("", "EMPTY", None, "[]")
