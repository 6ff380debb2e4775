"""Consistent-hash placement in bulk: ring, arcs, assignment, balance and remap reports.

Every node owns a number of positions on a ring of signed 64-bit integers; a key belongs to the
node at the first position at or after the key's own, wrapping past the last one to the first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.functions import text
from keystride.functions.hashing import ring_position
from keystride.params import MAX_BROADCAST_ROWS, VIRTUAL_NODES
from keystride.session import materialize

_LOWEST, _HIGHEST = -(2 ** 63), 2 ** 63 - 1
_BUCKET_BITS = 12  # 4096 slices of the ring; 64-bit positions are shifted down to a slice number
SPOTS_PER_TASK = 1_000_000  # positions that a task makes, and orders


def node_label(index: Column, spec: Column) -> Column:
    """``node-i (host:port/db)`` of one ``host:port[:db]`` item; the db defaults to 0."""
    parts = F.split(F.trim(spec), ":")
    db = F.coalesce(F.try_element_at(parts, F.lit(3)).cast("int"), F.lit(0))
    return F.format_string("node-%d (%s:%d/%d)", index, parts[0], parts[1].cast("int"), db)


def parse_nodes(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Comma-separated ``host:port[:db]`` lists to ``node_index, node``."""
    listed = specs.select(F.posexplode(F.split(F.col(column), ",")).alias("node_index", "item"))
    return listed.select("node_index", node_label(F.col("node_index"), F.col("item")).alias("node"))


def nodes_from_spec(spark: SparkSession, spec: str) -> DataFrame:
    return parse_nodes(spark.range(1).select(F.lit(spec).alias("spec")))


def _parts(nodes: DataFrame, each: int) -> int:
    """In how many parts a ring with ``each`` positions per node is made."""
    return max(1, math.ceil(nodes.count() * each / SPOTS_PER_TASK))


def _deal(nodes: DataFrame, parts: int) -> DataFrame:
    """A few small files of nodes become very many positions, so the nodes are dealt out before."""
    return nodes.repartition(parts) if parts > 1 else nodes


def _settle(spots: DataFrame, parts: int, by: Sequence[str] = ()) -> DataFrame:
    """``pos, node_index, node`` of numbered spots (``v``); if two positions collide the later one stays."""
    pos = ring_position(F.concat(F.col("node"), F.lit("#vn"), F.col("v").cast("string")))
    spots = spots.withColumn("pos", pos)
    if parts > 1:  # hardly any two collide, so nothing is gained by folding them before the shuffle
        spots = spots.repartition(parts, *by, "pos")
    last = F.max_by(F.struct("node_index", "node"), F.struct("node_index", "v"))
    return spots.groupBy(*by, "pos").agg(last.alias("n")).select(*by, "pos", "n.node_index", "n.node")


def build_ring(nodes: DataFrame, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``pos, node_index, node``; if two positions collide the later one stays."""
    parts = _parts(nodes, virtual_nodes)
    spots = _deal(nodes, parts).select(
        "node_index", "node", F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("v")
    )
    return _settle(spots, parts)


def _bucket(pos: Column, bits: int = _BUCKET_BITS) -> Column:
    return F.shiftright(pos, 64 - bits)


def build_arcs(ring: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``lo, hi, node_index, node``: a key with ``lo < position <= hi`` belongs to the node.

    Neighbours are found inside slices of the ring; between slices only their last positions (one
    row per slice, 4096 at most) are put in order, so no task holds all of a large ring.
    ``by`` keeps several rings apart.
    """
    sliced = ring.withColumn("_b", _bucket(F.col("pos")))
    lasts = sliced.groupBy(*by, "_b").agg(F.max("pos").alias("_last"))
    order = Window.partitionBy(*by)
    before = lasts.select(
        *by, "_b", F.lag("_last").over(order.orderBy("_b")).alias("_before"), F.max("_last").over(order).alias("_top")
    )
    inside = F.lag("pos").over(Window.partitionBy(*by, "_b").orderBy("pos"))
    placed = sliced.withColumn("_in", inside).join(F.broadcast(before), [*by, "_b"]).withColumn(
        "_lo", F.coalesce("_in", "_before")
    )

    def arc(lo: Column, hi: Column, closed: bool) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(closed).alias("closed"))

    # The lowest position owns all below it, and what lies past the highest one.
    wrapped = F.array(arc(F.lit(_LOWEST), F.col("pos"), True), arc(F.col("_top"), F.lit(_HIGHEST), False))
    normal = F.array(arc(F.col("_lo"), F.col("pos"), False))
    arcs = placed.select(
        *by, F.explode(F.when(F.col("_lo").isNull(), wrapped).otherwise(normal)).alias("a"), "node_index", "node"
    )
    # Small next to the keys, and read by every assignment.
    return materialize(arcs.select(*by, "a.lo", "a.hi", "a.closed", "node_index", "node"))


def assign(keys: DataFrame, arcs: DataFrame, key: str = "key", by: Sequence[str] = (),
           max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add ``pos, node_index, node`` to every key.

    The range condition is turned into an equality on ring slices, so a hash join is planned. Arcs
    are broadcast when there are few of them; beyond the bound both sides are shuffled by slice, and
    there are as many slices as leave a few arcs in each, so a key meets no more arcs on a larger
    ring. Keys that repeat without bound fall into one slice, whose part the merge join splits as it
    runs.
    """
    inside = ((F.col("pos") > F.col("lo")) | (F.col("closed") & (F.col("pos") == F.col("lo")))) & (
        F.col("pos") <= F.col("hi")
    )
    drop = ["_b", "lo", "hi", "closed"]
    bits = _BUCKET_BITS

    def spread() -> DataFrame:
        return arcs.withColumn("_b", F.explode(F.sequence(_bucket(F.col("lo"), bits), _bucket(F.col("hi"), bits))))

    small = spread().limit(max_broadcast + 1).count() <= max_broadcast
    if not small:
        bits = max(bits, arcs.count().bit_length() - 2)  # two to four arcs in a slice
    placed = keys.withColumn("pos", ring_position(F.col(key))).withColumn("_b", _bucket(F.col("pos"), bits))
    met = placed.join(F.broadcast(spread()), [*by, "_b"]) if small else placed.hint("merge").join(spread(), [*by, "_b"])
    return met.where(inside).drop(*drop)


def keys_per_node(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_index, node, keys``; nodes without keys show 0."""
    counted = assigned.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
    return nodes.join(counted, "node", "left").select(
        "node_index", "node", F.coalesce("keys", F.lit(0).cast("bigint")).alias("keys")
    )


def balance(keys: DataFrame, nodes: DataFrame, replica_counts: Sequence[int], key: str = "key") -> DataFrame:
    """Spread of keys over nodes for each number of virtual nodes.

    All rings are built in one plan and told apart by a column; the replica counts are a short list
    of literals, exploded next to the keys.
    """
    counts = F.array(*[F.lit(int(r)) for r in replica_counts])
    parts = _parts(nodes, sum(replica_counts))
    spots = _deal(nodes, parts).select("node_index", "node", F.explode(counts).alias("replicas"))
    spots = spots.select("*", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)).alias("v"))
    rings = _settle(spots, parts, ["replicas"])
    arcs = build_arcs(rings, ["replicas"])
    spread = keys.select(key, F.explode(counts).alias("replicas"))
    placed = assign(spread, arcs, key, ["replicas"]).groupBy("replicas", "node").agg(F.count(F.lit(1)).alias("keys"))
    every = nodes.select("node", F.explode(counts).alias("replicas"))
    filled = every.join(placed, ["replicas", "node"], "left").select(
        "replicas", "node", F.coalesce("keys", F.lit(0).cast("bigint")).alias("keys")
    )
    mean = F.avg("keys")
    return filled.groupBy("replicas").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum("keys").alias("keys"),
        F.max("keys").alias("max_keys"),
        F.min("keys").alias("min_keys"),
        (F.stddev_pop("keys") / mean).alias("relative_spread"),
        (F.max("keys") / mean).alias("max_over_mean"),
    )


def remap(keys: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame, virtual_nodes: int = VIRTUAL_NODES,
          key: str = "key") -> DataFrame:
    """Share of keys that change owner when membership changes, on the ring and under modulo."""
    old_size, new_size = old_nodes.count(), new_nodes.count()
    old_arcs = build_arcs(build_ring(old_nodes, virtual_nodes))
    new_arcs = build_arcs(build_ring(new_nodes, virtual_nodes))
    before = assign(keys.select(key), old_arcs, key).withColumnsRenamed({"node": "old_node"}).drop("node_index", "pos")
    both = assign(before, new_arcs, key).withColumnsRenamed({"node": "new_node"})
    moved = F.col("old_node") != F.col("new_node")
    modulo = F.pmod(F.col("pos"), F.lit(old_size)) != F.pmod(F.col("pos"), F.lit(new_size))
    return both.agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(moved.cast("bigint")), F.lit(0)).alias("ring_moved"),
        F.coalesce(F.sum(modulo.cast("bigint")), F.lit(0)).alias("modulo_moved"),
    ).select(
        "*",
        F.coalesce(F.try_divide(F.col("ring_moved"), F.col("keys")), F.lit(0.0)).alias("ring_share"),
        F.coalesce(F.try_divide(F.col("modulo_moved"), F.col("keys")), F.lit(0.0)).alias("modulo_share"),
    )


def placement(prefixes: DataFrame, nodes: DataFrame, stored: DataFrame, as_of,
              virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Where each prefix lives: key, owner, position, hit or miss, seconds to live, and the ring.

    ``stored`` is the materialized list table; the ring column lists every node with its live keys.
    """
    asked = prefixes.select(text.normalize(F.col("prefix")).alias("prefix")).withColumn(
        "cache_key", text.suggest_key(F.col("prefix"))
    )
    placed = assign(asked, build_arcs(build_ring(nodes, virtual_nodes)), "cache_key")
    live = stored.where(F.col("expires_at") > as_of).select("cache_key", "expires_at", "node")
    counted = keys_per_node(live, nodes)
    # One row per node in one array: as long as the node list.
    ring = counted.agg(F.sort_array(F.collect_list(F.struct(
        F.col("node_index"), F.col("node"), F.lit(virtual_nodes).alias("virtual_nodes"), F.col("keys").alias("live_keys")
    ))).alias("ring")).scalar()
    left = F.floor((F.unix_micros("expires_at") - F.unix_micros(as_of)) / F.lit(1_000_000))
    return placed.join(live.drop("node"), "cache_key", "left").select(
        "prefix", "cache_key", F.col("node").alias("owner"), F.col("pos").alias("position"),
        F.when(F.col("expires_at").isNotNull(), "HIT").otherwise("MISS").alias("status"),
        F.coalesce(left, F.lit(-2).cast("bigint")).alias("ttl_seconds"),
        ring.alias("ring"),
    )
