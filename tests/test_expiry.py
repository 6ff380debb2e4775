import random

import pytest
from pyspark.sql import functions as F

from keystride.operators import expiry, reports


def brute_force(rows, ttl, ends=None):
    ends, filled = dict(ends or {}), set()
    for ms, req_id, key in sorted((m, i, k) for i, k, m in rows):
        if ms >= ends.get(key, -1):
            ends[key] = ms + ttl
            filled.add((key, ms, req_id))
    return filled


@pytest.fixture(scope="module")
def requests(spark):
    rng = random.Random(1)
    shape = {"hot": (3000, 400_000), "dense": (4000, 6_000), "cold": (5, 900_000), "one": (1, 10), "gap": (200, 4_000_000)}
    rows = [(key, rng.randrange(span)) for key, (n, span) in shape.items() for _ in range(n)]
    rows = [(i, key, ms) for i, (key, ms) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "req_id long, key string, ms long")
    return rows, frame.select("req_id", "key", F.timestamp_millis("ms").alias("ts")).repartition(5)


def refilled(frame, ttl, **options):
    got = expiry.refills(frame, "key", ttl, **options).select("key", "filled_ms", "req_id").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("ttl, task_entries, folded", [
    (100, 10 ** 6, 10 ** 6), (7, 10 ** 6, 10 ** 6), (100, 10 ** 6, 0), (100, 600, 0), (100, 60, 0), (7, 60, 0), (1500, 600, 0)])
def test_refills_equal_a_replay_in_order(requests, ttl, task_entries, folded):
    """Small bounds force slices and several levels of composition."""
    rows, frame = requests
    assert refilled(frame, ttl, task_entries=task_entries, folded_entries=folded) == brute_force(rows, ttl)


def test_short_keys_need_no_python(requests):
    _, frame = requests
    plan = expiry.refills(frame, "key", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("task_entries", [10 ** 6, 60])
def test_entries_carry_over(requests, spark, task_entries):
    rows, frame = requests
    cut = 200_000
    early = [r for r in rows if r[2] < cut]
    late = [r for r in rows if r[2] >= cut]
    first = expiry.refills(frame.where(F.unix_millis("ts") < cut), "key", 1500, task_entries=task_entries)
    alive = expiry.open_entries(first, "key", 1500)
    got = refilled(frame.where(F.unix_millis("ts") >= cut), 1500, entries=alive, task_entries=task_entries)
    assert {r[:2] for r in brute_force(early, 1500)} == {tuple(r) for r in first.select("key", "filled_ms").collect()}
    assert got == brute_force(rows, 1500) - brute_force(early, 1500)
    assert len(late) > len(got)


def test_a_hit_does_not_extend_the_entry(spark):
    rows = [(1, "k", 0), (2, "k", 900), (3, "k", 999), (4, "k", 1000), (5, "k", 1999), (6, "k", 2000)]
    frame = spark.createDataFrame(rows, "req_id long, key string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    labelled = expiry.label_hits(frame, "key", 1000)
    assert {r.req_id for r in labelled.where("source = 'COMPUTED'").collect()} == {1, 4, 6}
    assert reports.hit_rate(labelled).first().hit_rate == 0.5


@pytest.mark.parametrize("bound", [1, 1_000_000])
def test_null_keys_have_refills(spark, bound):
    rows = [(None, 0, 1), (None, 5_000, 2), ("a", 0, 3), ("a", 5_000, 4), ("a", 5_500, 5)]
    log = spark.createDataFrame(rows, "k string, ms long, req_id long").withColumn("ts", F.timestamp_millis("ms"))
    got = expiry.refills(log, "k", 1000, task_entries=bound).collect()
    assert sorted(r.req_id for r in got) == [1, 2, 3, 4]
