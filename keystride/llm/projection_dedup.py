"""Near-duplicate vectors found by sorted projection passes.

In each pass the signs of random projections are concatenated to a code; vectors are ordered by
(label, code) and each is compared with the ``window`` vectors after it. Close vectors share long
beginnings of their codes with a probability that falls with their angle, so they come near each other
in some pass; pairs verified in any pass are united. Precision is exact (cosine in double precision).

How many passes a label takes follows from its size (``passes_of``): a bit of two vectors at the threshold
agrees with probability ``1 - angle / pi``, and they come within a window of ``w`` among ``n`` vectors if
about ``log2(n / w)`` leading bits agree. There are as many passes as bring such a pair together in one of
them with probability ``RECALL``, and ``PASSES`` at least. Closer pairs, and pairs that others connect, are
found with a higher one. The tests measure it.

A window bounds the partners seen in a pass, so the passes only find the classes. Links are then counted
exactly within each class: every pair of its vectors is compared once. A class is cut into chunks by the
hashes of its keys, and each pair of chunks is a task; small classes share tasks. Tasks give a number per
vector, not pairs. The comparisons grow with the square of a class, the rows do not.

Equal vectors of one label are one vertex, so copies are never paired, and they count in full. A
window is the same number of rows for every vector, so a crowded label or a hot code is cut into
blocks of rows like any other part of the order. Each pass is a range partition of the order: position
ranges become blocks, and the first rows of a block also go to the block before it.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
link with nothing: no links, a component of their own, kept. Vectors of different lengths are not
compared. Rows with the same id are separate vectors. A null id is passed over in class ids; a vector
without any id in its class has none, and is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.llm.common import bound_batches, connected_components, meet, ship
from keystride.llm.vectors import directions, is_usable, matrix
from keystride.session import materialize

THRESHOLD = 0.93
PASSES = 14        # the least
RECALL = 0.99      # of pairs at the threshold that no other vectors connect
CODE_BITS = 62
WINDOW = 384
BLOCK = 1536
SEED = 5
LEAST_CHUNK, MOST_CHUNK = 256, 8192  # vectors of a class's chunk
SLICE = 512  # rows of a chunk compared at a time
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these


def passes_of(n: Column, threshold: float = THRESHOLD, window: int = WINDOW, least: int = PASSES) -> Column:
    """Passes for a label of ``n`` distinct vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    met = F.pow(F.lit(agree), F.greatest(F.log2(n / F.lit(float(window))), F.lit(0.0)))
    needed = F.ceil(F.lit(math.log(1 - RECALL)) / F.log(1 - F.least(met, F.lit(1 - 1e-9))))
    return F.greatest(needed, F.lit(least)).cast("int")


def with_passes(distinct: DataFrame, threshold: float, window: int, least: int) -> DataFrame:
    """Add ``passes``, by the number of vectors of a label and length."""
    by = ["label", "dims"]
    sized = distinct.withColumn("dims", F.size("vector"))
    counts = materialize(sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    needed = counts.select(*by, passes_of(F.col("n"), threshold, window, least).alias("passes"))
    return meet(sized, needed, by).drop("dims")


def codes(distinct: DataFrame, seed: int) -> DataFrame:
    """``pass, label, dims, code, key, vector`` for each of a vector's ``passes``."""
    def run(batches):
        powers = 1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)
        for rows in batches:
            sizes = rows.column("vector").value_lengths().to_numpy()
            for dims in np.unique(sizes):
                whole = rows.filter(pa.array(sizes == dims))
                passes = whole.column("passes").to_numpy()
                for p in range(int(passes.max())):
                    part = whole if (passes > p).all() else whole.filter(pa.array(passes > p))
                    unit = directions(matrix(part.column("vector")))
                    planes = np.random.default_rng([seed, p, int(dims)]).normal(size=(int(dims), CODE_BITS))
                    code = ((unit @ planes) > 0) @ powers
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, np.int32)), part.column("label"), pa.array(np.full(n, dims, np.int32)),
                         pa.array(code), part.column("key"), part.column("vector")],
                        names=["pass", "label", "dims", "code", "key", "vector"])

    ship(distinct.sparkSession)
    bound_batches(distinct.sparkSession)
    schema = f"pass int, label string, dims int, code bigint, key bigint, vector {distinct.schema['vector'].dataType.simpleString()}"
    return distinct.select("label", "key", "vector", "passes").mapInArrow(run, schema)


def in_blocks(ordered: DataFrame, block: int, window: int) -> DataFrame:
    """Add ``place`` in the whole order and ``block``; the first rows of a block are also in the one before."""
    numbered = materialize(ordered.withColumn("_seq", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_seq", _ROW_BITS))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    starts = materialize(sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    inside = F.col("_seq") - F.shiftleft("_part", _ROW_BITS)
    placed = numbered.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + inside)
    own = F.expr(f"place div {block}")
    early = (F.col("place") % block < window) & (F.col("place") >= block)
    blocks = F.when(early, F.array(own, own - 1)).otherwise(F.array(own))
    return placed.select("pass", "label", "dims", "key", "vector", "place", F.explode(blocks).alias("block"))


def united(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest that pairs ``i, j`` connect it with."""
    least = np.arange(n)
    while True:
        lower = np.minimum(least[i], least[j])
        after = least.copy()
        np.minimum.at(after, i, lower)
        np.minimum.at(after, j, lower)
        after = after[after]
        if np.array_equal(after, least):
            return least
        least = after


def class_edges(distinct: DataFrame, threshold: float, window: int, block: int, seed: int) -> DataFrame:
    """``a, b`` with ``a < b``: keys that verified pairs connect, at most one row per vector, pass and block.

    ``distinct``: ``key, label, vector, passes``.
    """
    if block < window:
        raise ValueError("a block holds at least a window")
    order = ["pass", "label", "dims", "code", "key"]
    ordered = codes(distinct, seed).repartitionByRange(*order).sortWithinPartitions(*order).drop("code")
    blocks = in_blocks(ordered, block, window)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", ignore_index=True)
        found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        # Vectors of one pass, label and length stand together.
        runs = (rows[["pass", "label", "dims"]] != rows[["pass", "label", "dims"]].shift()).any(axis=1).cumsum()
        own = rows["place"].to_numpy() // block == rows["block"].to_numpy()
        keys = rows["key"].to_numpy()
        for _, at in rows.groupby(runs.to_numpy(), sort=False).indices.items():
            unit = directions(np.array(rows["vector"].iloc[at].tolist(), dtype=np.float64))
            for low in range(0, len(at), window):
                mine = slice(low, min(low + window, len(at)))
                cosine = unit[mine] @ unit[low:low + 2 * window].T
                i, j = np.nonzero(cosine >= threshold)
                good = (j > i) & (j - i <= window) & own[at[low + i]]
                found_i.append(at[low + i[good]])
                found_j.append(at[low + j[good]])
        least = united(len(rows), np.concatenate(found_i), np.concatenate(found_j))
        led = np.flatnonzero(least != np.arange(len(rows)))
        a, b = keys[least[led]], keys[led]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return blocks.groupBy("block").applyInPandas(compare, "a bigint, b bigint").distinct()


def count_links(members: DataFrame, threshold: float, least_chunk: int = LEAST_CHUNK, most_chunk: int = MOST_CHUNK) -> DataFrame:
    """``key, links``: rows that the other vectors of its class within ``threshold`` stand for, if there are any.

    ``members``: ``key, root, size`` (vectors of the class) ``, n`` (rows of the vector) ``, vector``.
    """
    # Chunks grow with the class, so neither its tasks nor the copies of a vector become too many.
    chunk_rows = F.greatest(F.lit(float(least_chunk)), F.least(F.lit(float(most_chunk)), 8 * F.sqrt("size")))
    cut = members.withColumn("chunks", F.ceil(F.col("size") / chunk_rows).cast("int"))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    small = members.where(F.col("size") <= least_chunk).count()
    packs = max(1, -(-small // least_chunk))
    whole = F.col("chunks") == 1
    others = F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    paired = cut.select("key", "root", "n", "vector", "chunk", "chunks", others.alias("other"))
    # Classes of one chunk share tasks; a task of a larger one has its root and two chunks.
    dealt = paired.select(
        "key", "root", "n", "vector", "chunk",
        F.when(whole, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root")).alias("task"),
        F.when(whole, -1).otherwise(F.least("chunk", "other")).alias("low"),
        F.when(whole, -1).otherwise(F.greatest("chunk", "other")).alias("high"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["root", "chunk", "key"], ignore_index=True)
        first = int(rows["low"].iloc[0])
        links = np.zeros(len(rows))
        n, chunk = rows["n"].to_numpy(np.float64), rows["chunk"].to_numpy()
        for _, at in rows.groupby("root", sort=False).indices.items():
            unit = directions(np.array(rows["vector"].iloc[at].tolist(), dtype=np.float64))
            # Places are in order: of two chunks those of the second come last.
            across = first >= 0 and first != rows["high"].iloc[0]
            split = int((chunk[at] == first).sum()) if across else len(at)
            for low in range(0, split, SLICE):
                mine = slice(low, min(low + SLICE, split))
                start = split if across else low
                near = unit[mine] @ unit[start:].T >= threshold
                if not across:
                    near &= np.arange(len(at) - start) > np.arange(near.shape[0])[:, None]
                links[at[mine]] += near @ n[at[start:]]
                links[at[start:]] += n[at[mine]] @ near
        some = links > 0
        return pd.DataFrame({"key": rows["key"][some], "links": links[some].astype(np.int64)})

    ship(members.sparkSession)
    counted = dealt.groupBy("task", "low", "high").applyInPandas(count, "key bigint, links bigint")
    return counted.groupBy("key").agg(F.sum("links").alias("links"))


def group(embeddings: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, block: int = BLOCK,
          seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; ``passes`` sets a number for all labels."""
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("vector"),
                             F.col(f"`{label}`").cast("string").alias("label"))
    usable = is_usable(F.col("vector")) & F.col("label").isNotNull()
    split = rows.withColumn("usable", usable)
    # Copies are one vertex: a hot one is one row per task after the partial aggregation.
    grouped = split.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = materialize(grouped.withColumn("key", F.monotonically_increasing_id()))
    numbered = with_passes(distinct, threshold, window, PASSES) if passes is None else distinct.withColumn("passes", F.lit(passes))
    edges = materialize(class_edges(numbered, threshold, window, block, seed))
    roots = connected_components(edges).withColumnRenamed("v", "key")
    rooted = materialize(distinct.drop("vector", "label").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    sized = materialize(rooted.join(least, "root").select("key", "n", "root", "size", "component_id"))
    members = materialize(sized.where("size > 1").join(distinct.select("key", "vector"), "key"))
    linked = count_links(members, threshold)
    classes = sized.join(linked, "key", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = materialize(distinct.select("label", "vector", "key").join(classes, "key"))
    found = split.where("usable").join(known.drop("key"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = split.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.unionByName(alone).withColumn("kept", kept)
