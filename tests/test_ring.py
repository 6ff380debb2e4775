import bisect
import hashlib

import pytest
from pyspark.sql import functions as F

from keystride.operators import ring, serving

SPEC = "localhost:6379:0, localhost:6379:1,cache-b:7000"
LABELS = ["node-0 (localhost:6379/0)", "node-1 (localhost:6379/1)", "node-2 (cache-b:7000/0)"]


def spot(key):
    return int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big", signed=True)


class PlainRing:
    """The rule in a few lines of Python."""

    def __init__(self, labels, virtual_nodes=150):
        self.owner = {spot(f"{n}#vn{v}"): n for n in labels for v in range(virtual_nodes)}
        self.places = sorted(self.owner)

    def of(self, key):
        at = bisect.bisect_left(self.places, spot(key))
        return self.owner[self.places[at % len(self.places)]]


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([(f"suggest:{i}",) for i in range(3000)], "key string")


def test_node_specs(spark):
    assert [r.node for r in ring.nodes_from_spec(spark, SPEC).orderBy("node_index").collect()] == LABELS


def test_ring_and_arcs_cover_everything_once(spark):
    spots = ring.build_ring(ring.nodes_from_spec(spark, SPEC))
    assert spots.count() == 450
    arcs = sorted((r.lo, r.hi, r.closed) for r in ring.build_arcs(spots).collect())
    assert arcs[0][0] == -(2 ** 63) and arcs[0][2] and arcs[-1][1] == 2 ** 63 - 1
    assert all(a[1] == b[0] and not b[2] for a, b in zip(arcs, arcs[1:]))


@pytest.mark.parametrize("virtual_nodes", [1, 2, 150])
@pytest.mark.parametrize("max_broadcast", [10 ** 6, 0])
def test_assignment_equals_a_plain_ring(spark, keys, virtual_nodes, max_broadcast):
    plain = PlainRing(LABELS, virtual_nodes)
    arcs = ring.build_arcs(ring.build_ring(ring.nodes_from_spec(spark, SPEC), virtual_nodes))
    twice = keys.unionByName(keys.limit(10))
    got = ring.assign(twice, arcs, max_broadcast=max_broadcast).collect()
    assert len(got) == 3010 and all(r.node == plain.of(r.key) and r.pos == spot(r.key) for r in got)


def test_a_large_ring_is_made_in_parts(spark, monkeypatch):
    nodes = spark.range(40).coalesce(1).select(F.col("id").cast("int").alias("node_index"), F.concat(F.lit("n"), "id").alias("node"))
    whole = {tuple(r) for r in ring.build_ring(nodes).collect()}
    monkeypatch.setattr(ring, "SPOTS_PER_TASK", 1000)
    made = ring.build_ring(nodes)
    assert {tuple(r) for r in made.collect()} == whole and len(whole) == 6000
    assert made.rdd.getNumPartitions() == 6
    assert max(made.rdd.glom().map(len).collect()) < 1500


def test_a_key_meets_a_few_arcs_however_large_the_ring(spark, keys):
    labels = [f"n{i}" for i in range(400)]
    nodes = spark.createDataFrame(list(enumerate(labels)), "node_index int, node string")
    arcs = ring.build_arcs(ring.build_ring(nodes))
    assigned = ring.assign(keys, arcs, max_broadcast=0)
    plan = assigned._jdf.queryExecution().analyzed().toString()
    plain = PlainRing(labels)
    assert {(r.key, r.node) for r in assigned.collect()} == {(k, plain.of(k)) for k in (f"suggest:{i}" for i in range(3000))}
    # 60,001 arcs in 2 ** 14 slices; an owner is found by one join.
    assert "shiftright(pos" in plan and ", 50)" in plan and plan.count("Join ") == 1


def test_single_node_owns_all(spark, keys):
    arcs = ring.build_arcs(ring.build_ring(ring.nodes_from_spec(spark, "h:1"), 1))
    assert {r.node for r in ring.assign(keys, arcs).collect()} == {"node-0 (h:1/0)"}


def test_ring_join_is_a_hash_join(spark, keys):
    arcs = ring.build_arcs(ring.build_ring(ring.nodes_from_spec(spark, SPEC)))
    plan = ring.assign(keys, arcs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_nodes_without_keys_show_zero(spark, keys):
    nodes = ring.nodes_from_spec(spark, SPEC)
    arcs = ring.build_arcs(ring.build_ring(nodes, 1))
    few = ring.assign(keys.limit(1), arcs)
    assert sorted(r["keys"] for r in ring.keys_per_node(few, nodes).collect()) == [0, 0, 1]


def test_only_keys_of_the_new_node_move(spark, keys):
    more = SPEC + ",extra:1"
    old, new = ring.nodes_from_spec(spark, SPEC), ring.nodes_from_spec(spark, more)
    got = ring.remap(keys, old, new).first()
    plain_old, plain_new = PlainRing(LABELS), PlainRing([*LABELS, "node-3 (extra:1/0)"])
    ours = [f"suggest:{i}" for i in range(3000)]
    moved = [k for k in ours if plain_old.of(k) != plain_new.of(k)]
    assert got.ring_moved == len(moved) and all(plain_new.of(k) == "node-3 (extra:1/0)" for k in moved)
    assert got.modulo_moved == sum(spot(k) % 3 != spot(k) % 4 for k in ours)


def test_balance_per_replica_count(spark, keys):
    got = {r.replicas: r for r in ring.balance(keys, ring.nodes_from_spec(spark, SPEC), [1, 150]).collect()}
    for replicas, r in got.items():
        plain = PlainRing(LABELS, replicas)
        counts = [sum(plain.of(f"suggest:{i}") == n for i in range(3000)) for n in LABELS]
        assert (r["keys"], r.max_keys, r.min_keys) == (3000, max(counts), min(counts))


def test_placement_report(spark):
    nodes = ring.nodes_from_spec(spark, SPEC)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ranked = spark.createDataFrame([("ip", 1, "iphone", 5), ("ja", 1, "java", 3)], "prefix string, rank int, query string, count long")
    arcs = ring.build_arcs(ring.build_ring(nodes))
    stored = serving.materialize_lists(ranked, arcs, now)
    asked = spark.createDataFrame([(" IP",), ("zz",)], "prefix string")
    got = {r.prefix: r for r in ring.placement(asked, nodes, stored, now).collect()}
    plain = PlainRing(LABELS)
    assert (got["ip"].status, got["ip"].ttl_seconds, got["ip"].owner) == ("HIT", 60, plain.of("suggest:ip"))
    assert (got["zz"].status, got["zz"].ttl_seconds) == ("MISS", -2)
    assert [(n.node, n.virtual_nodes) for n in got["ip"].ring] == [(n, 150) for n in LABELS]
    assert sum(n.live_keys for n in got["ip"].ring) == 2
