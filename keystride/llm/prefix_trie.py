"""Trie of conversation prefixes with subtree totals, rolled up by bands of depths.

A conversation is a sequence of turns (role, text); every distinct beginning of one is a node, from the
textless root down. A prefix is named by its depth and 128 bits: the exclusive or of SHA-256 values of
its (position, role, text), so names of all prefixes come from one running aggregate, and no sequence is
ever gathered.

Subtree totals: depths are cut into bands of equal height. A node is exploded to its ancestors within
its band only, and one aggregation gives the totals inside all bands. Then the totals of band roots, the
nodes at a band's first depth, are completed band by band from the deepest up, each round over band
roots alone, and each completed root is exploded once to its ancestors in the band above. With height
``h`` and greatest depth ``d`` that is at most ``h`` rows a node and ``d / h`` rounds; the default height
is the root of ``d``, at least 8.

Turns are ordered by turn number, null first; turns of equal number by their digests. Null roles and
texts are empty. Rows without a conversation id belong to no conversation and are passed over. Repeated
rows are repeated turns. A conversation may be of any length, and any share of all conversations may be
alike. An empty table has no nodes. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.llm.common import bound_batches, digest_lanes, meet, ship
from keystride.operators.ordered import row_numbers
from keystride.params import MAX_GROUP_ROWS
from keystride.session import materialize

LEAST_HEIGHT = 8
CHUNK_BITS = 12          # ids of equal higher bits are joined to one text before a node's digest
BORROWERS, MOST_BORROWED = 20, 3
NODE = ["depth", "a", "b"]
# What a word is.
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``conv_id, pos, c0, c1, words``: numbered turns from 1, contents as digests."""
    role_text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    digest = F.sha2(F.concat(F.char_length(role_text[0]).cast("string"), F.lit(":"), *role_text).cast("binary"), 256)
    rows = conversations.select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"),
        F.regexp_count(role_text[1], F.lit(WORD)).cast("bigint").alias("words")).where("conv_id is not null")
    c0, c1 = digest_lanes(F.col("digest"), 2)
    rows = rows.select("conv_id", "turn", c0.alias("c0"), c1.alias("c1"), "words")
    order = [F.asc_nulls_first("turn"), F.asc("c0"), F.asc("c1")]
    return row_numbers(rows, ["conv_id"], order, "pos", max_group_rows).select("conv_id", "pos", "c0", "c1", "words")


def share_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their twenty.

    Of conversation ``c`` the first ``h = crc32(c) % 4`` turns are replaced by as many of conversation
    ``c - c % 20``, or by all it has. Returns the new turns and ``conv_id`` of all conversations, of which
    some may have lost every turn.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    replaced = F.crc32(F.col("conv_id").cast("string")) % (MOST_BORROWED + 1)
    lender = F.col("conv_id") - F.col("conv_id") % BORROWERS
    convs = materialize(sizes.select("conv_id", lender.alias("lender")).join(
        sizes.select(F.col("conv_id").alias("lender"), F.col("n").alias("has")), "lender", "left").select(
        "conv_id", "lender", replaced.alias("h"), F.least(replaced, F.coalesce("has", F.lit(0))).alias("taken")))
    openings = turns.where(F.col("pos") <= MOST_BORROWED).withColumnRenamed("conv_id", "lender")
    borrowed = convs.join(openings, "lender").where("pos <= taken").select(*turns.columns)
    own = meet(turns, convs.select("conv_id", "h", "taken"), ["conv_id"]).where("pos > h")
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select(*turns.columns)
    return borrowed.unionByName(own), convs.select("conv_id")


def band_height(deepest: int) -> int:
    return max(LEAST_HEIGHT, math.isqrt(max(deepest, 0)) + 1)


def memberships(turns: DataFrame, convs: DataFrame, deepest: int, height: int, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """A row per conversation and prefix of it: ``conv_id, depth, a, b, pa, pb, words, is_end``."""
    tag = F.sha2(F.concat_ws(",", "pos", "c0", "c1").cast("binary"), 256)
    t0, t1 = digest_lanes(F.col("tag"), 2)
    steps = turns.withColumn("tag", tag).select("conv_id", F.col("pos").alias("depth"), t0.alias("t0"), t1.alias("t1"), "words")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("t0"), zero.alias("t1"), zero.alias("words"))
    steps = steps.unionByName(roots)
    if deepest <= max_group_rows:
        along = Window.partitionBy("conv_id").orderBy("depth")
        named = steps.select("*", F.bit_xor("t0").over(along).alias("a"), F.bit_xor("t1").over(along).alias("b"),
                             F.lead("depth").over(along).isNull().alias("is_end"))
    else:
        # Long conversations: running values within stretches, then the stretches before them.
        steps = materialize(steps.withColumn("stretch", F.floor(F.col("depth") / height)))
        sums = steps.groupBy("conv_id", "stretch").agg(F.bit_xor("t0").alias("s0"), F.bit_xor("t1").alias("s1"))
        before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        later = F.lead("stretch").over(Window.partitionBy("conv_id").orderBy("stretch"))
        carried = sums.select("conv_id", "stretch", later.isNull().alias("last"), *[
            F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("s0", "s1")])
        along = Window.partitionBy("conv_id", "stretch").orderBy("depth")
        named = steps.join(carried, ["conv_id", "stretch"]).select(
            "conv_id", "depth", "t0", "t1", "words", *[
                F.bit_xor(t).over(along).bitwiseXOR(F.col(s)).alias(n) for t, s, n in (("t0", "s0", "a"), ("t1", "s1", "b"))],
            (F.col("last") & F.lead("depth").over(along).isNull()).alias("is_end"))
    return named.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("t0")).alias("pa"),
                        F.col("b").bitwiseXOR(F.col("t1")).alias("pb"), "words", "is_end")


def _exploded(rows: DataFrame, last_depth: Column, values: list[str]) -> DataFrame:
    """``rows`` with a ``path`` of names that ends at ``last_depth``, handed to every node of the path."""
    spread = rows.select(last_depth.alias("_last"), F.size("path").alias("_n"), *values, F.posexplode("path").alias("_i", "_node"))
    return spread.select((F.col("_last") - F.col("_n") + 1 + F.col("_i")).alias("depth"),
                         F.col("_node.a").alias("a"), F.col("_node.b").alias("b"), *values)


def subtree_sums(nodes: DataFrame, members: DataFrame, deepest: int, height: int, values: list[str]) -> DataFrame:
    """Sums of ``values`` over each node's subtree: ``depth, a, b`` and the sums.

    ``nodes`` has a row per node with the conversation (``conv_id``) that names it; ``members`` has that
    conversation's rows, from which the paths within bands are taken.
    """
    added = [F.sum(v).alias(v) for v in values]
    along = Window.partitionBy("conv_id", "band").orderBy("depth")
    paths = members.withColumn("band", F.floor(F.col("depth") / height)).select(
        "conv_id", "depth", F.collect_list(F.struct("a", "b")).over(along).alias("path"))
    roots = nodes.where((F.col("depth") > 0) & (F.col("depth") % height == 0))
    needed = nodes.select("conv_id", "depth").unionByName(roots.select("conv_id", (F.col("depth") - 1).alias("depth"))).distinct()
    paths = materialize(paths.join(needed, ["conv_id", "depth"]))
    inside = _exploded(nodes.join(paths, ["conv_id", "depth"]), F.col("depth"), values)
    inside = materialize(inside.groupBy(*NODE).agg(*added))
    if deepest < height:
        return inside
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), "path")
    roots = materialize(roots.select("conv_id", *NODE).join(inside, NODE).join(above, ["conv_id", "depth"]).drop("conv_id"))
    completed, below = [], None
    for first in range(deepest // height * height, 0, -height):
        here = roots.where(F.col("depth") == first)
        if below is not None:
            handed = below.select((F.col("depth") - height).alias("depth"), F.col("path")[0]["a"].alias("a"),
                                  F.col("path")[0]["b"].alias("b"), *values).groupBy(*NODE).agg(*[F.sum(v).alias(f"_{v}") for v in values])
            here = here.join(handed, NODE, "left").select(
                *NODE, "path", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        below = materialize(here.select(*NODE, "path", *values))
        completed.append(below)
    passed = _exploded(reduce(DataFrame.unionByName, completed), F.col("depth") - 1, values)
    return inside.unionByName(passed).groupBy(*NODE).agg(*added)


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: SHA-256 of the ascending ids of the conversations that end at a node.

    Ids are joined natively to texts of at most 2 ** ``CHUNK_BITS`` of them; a node's texts are then
    digested one after the other as they stream by in order.
    """
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    chunks = ends.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))
    placed = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    ship(ends.sparkSession)
    bound_batches(ends.sparkSession)
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == at:
                    digest.update(b"," + ids.encode())
                else:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, digest.hexdigest()), schema, strict=True)], schema=schema)

    return placed.mapInArrow(run, "depth bigint, a bigint, b bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, height: int | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is named by its smallest member and its depth. ``saved_tokens`` are the words of prefixes that
    need not be read again where members share them, over the whole subtree.
    """
    turns = materialize(turns)
    deepest = turns.agg(F.max("pos")).first()[0] or 0
    height = height or band_height(deepest)
    members = materialize(memberships(turns, convs, deepest, height, max_group_rows))
    nodes = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    nodes = materialize(nodes)
    upward = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.where("depth > 0").select(*upward).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = materialize(counted.select(
        "*", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(counted.select(*NODE, "conv_id", *values), members.select("conv_id", *NODE), deepest, height, values)
    own = counted.drop(*values).join(sums, NODE)
    ends = end_digests(members.where("is_end").select(*NODE, "conv_id"))
    own = materialize(own.join(ends, NODE, "left"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                         F.col("conv_id").alias("parent_conv_id"))
    # The root may be the parent of a third of all nodes.
    return meet(own, above, ["depth", "pa", "pb"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("bigint").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
