import random

import pytest
from pyspark.sql import functions as F

from keystride.operators import ordered, replay, reports


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; times repeat."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", rng.randrange(300)) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "id long, key string, t long").repartition(7)


@pytest.mark.parametrize("bound", [10 ** 6, 0])
@pytest.mark.parametrize("by", [["key"], []])
def test_row_numbers(skewed, bound, by, values):
    rows, df = skewed
    got = values(ordered.row_numbers(df, by, [F.desc("t"), F.asc("id")], "n", bound), "id", "n")
    groups = {}
    for i, key, t in rows:
        groups.setdefault(key if by else None, []).append((-t, i))
    assert got == sorted((i, n) for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1))


@pytest.mark.parametrize("bound", [10 ** 6, 0])
def test_next_value(skewed, bound, values):
    rows, df = skewed
    got = ordered.next_value(df, ["key"], [F.asc("t"), F.asc("id")], F.col("t") * 2, "next", bound)
    groups = {}
    for i, key, t in rows:
        groups.setdefault(key, []).append((t, i))
    wanted = {}
    for g in groups.values():
        g.sort()
        for (_, i), after in zip(g, [*g[1:], None]):
            wanted[i] = after and after[0] * 2
    assert {r.id: r.next for r in got.collect()} == wanted
    assert got.columns == [*df.columns, "next"] or set(got.columns) == {*df.columns, "next"}


def test_next_value_may_be_null_inside_a_group(spark, values):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id long, v long").withColumn("k", F.lit("a"))
    for bound in (10 ** 6, 0):
        got = ordered.next_value(df, ["k"], [F.asc("id")], F.col("v"), "n", bound)
        assert {r.id: r.n for r in got.collect()} == {1: 5, 2: None, 3: None}


@pytest.mark.parametrize("bound", [10 ** 6, 0])
def test_latency_picks_exact_elements(spark, bound):
    took = [float((i * 37) % 101) for i in range(101)]
    log = spark.createDataFrame(list(enumerate(took)), "req_id long, took_ms double")
    ranked = sorted(took)
    first = reports.latency(log, "floor_n", max_group_rows=bound).first()
    assert (first.p50, first.p95, first.p99) == tuple(ranked[int(q * 101) - 1] for q in (0.5, 0.95, 0.99))
    second = reports.latency(log, "floor_n_1", max_group_rows=bound).first()
    assert (second.p50, second.p95, second.p99) == tuple(ranked[int(q * 100)] for q in (0.5, 0.95, 0.99))
    sketch = reports.latency_approximate(log).first()
    assert abs(sketch.p95 - first.p95) <= 1 and sketch.n == 101


def test_latency_of_one_request(spark):
    log = spark.createDataFrame([(1, 4.0)], "req_id long, took_ms double")
    got = reports.latency(log, "floor_n").first()
    assert (got.p50, got.p99, got.mean) == (0.0, 0.0, 4.0)
    assert reports.latency(log, "floor_n_1").first().p99 == 4.0


def request_log(spark, rows):
    return spark.createDataFrame(rows, "req_id long, user_id long, ms long, prefix string, took_ms double").withColumn(
        "ts", F.timestamp_millis("ms"))


@pytest.mark.parametrize("bound", [10 ** 6, 0])
def test_debounce_keeps_the_last_of_a_burst(spark, bound):
    log = request_log(spark, [
        (1, 1, 0, "a", 0.0), (2, 1, 100, "ab", 0.0), (3, 1, 300, "abc", 0.0), (4, 1, 499, " ", 0.0), (5, 1, 700, "z", 0.0),
        (6, 2, 150, "q", 0.0),
    ])
    kept = {r.req_id for r in replay.debounce(log, 0.2, max_group_rows=bound).collect()}
    assert kept == {2, 5, 6}  # 4 is quiet but blank, and silences 3


def test_superseded(spark):
    log = request_log(spark, [(1, 1, 0, "a", 50.0), (2, 1, 50, "b", 51.0), (3, 1, 100, "c", 9.0), (4, 2, 10, "d", 1.0)])
    got = {r.req_id: r.superseded for r in replay.mark_superseded(log).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_hit_rate_and_traffic(spark):
    log = spark.createDataFrame([("CACHE",), ("CACHE",), ("DB",), ("TRIE",), ("DB+RECENCY",), ("EMPTY",)], "source string")
    got = reports.hit_rate(log).first()
    assert (got.hits, got.misses, got.hit_rate) == (2, 3, 0.4)
    assert reports.hit_rate(log.limit(0)).first().hit_rate == 0.0
    traffic = reports.store_traffic(log, spark.range(7)).first()
    assert (traffic.reads, traffic.writes) == (2, 7)


def test_table_statistics(spark):
    table = spark.createDataFrame([("A", "a", 3), ("a", "a", 2), ("b", "b", -1)], "query string, query_norm string, count long")
    assert tuple(reports.table_statistics(table).first()) == (3, 2, 4)
    assert tuple(reports.table_statistics(table, exact=False).first()) == (3, 2, 4)
    assert tuple(reports.table_statistics(table.limit(0)).first()) == (0, 0, 0)


@pytest.mark.parametrize("bound", [1, 1_000_000])
def test_null_groups_stay(spark, bound):
    rows = [(None, 1), (None, 2), ("a", 3), ("a", 4)]
    frame = spark.createDataFrame(rows, "g string, v int")
    got = ordered.row_numbers(frame, ["g"], [F.asc("v")], "n", bound).collect()
    assert sorted((r.v, r.n) for r in got) == [(1, 1), (2, 2), (3, 1), (4, 2)]
    got = ordered.next_value(frame, ["g"], [F.asc("v")], F.col("v"), "n", bound).collect()
    assert sorted((r.v, r.n or 0) for r in got) == [(1, 2), (2, 0), (3, 4), (4, 0)]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_hot_join_equals_plain_join(spark, bound):
    left = spark.createDataFrame([("a", i) for i in range(100)] + [(None, 1), ("c", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, w int")
    got = sorted((r.k or "", r.v, r.w or 0) for r in ordered.join_hot(left, right, ["k"], "left", max_broadcast=bound).collect())
    assert got == sorted([("a", i, 1) for i in range(100)] + [("", 1, 2), ("c", 2, 0)])
