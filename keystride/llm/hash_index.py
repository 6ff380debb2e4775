"""Exact duplicates found through an extendible-hash index on shared files.

A text's key is the XXH64 of its normal form (each run of the six ASCII spaces is one space). A key
that occurs once needs no bucket: its text has no equal. All rows of the other keys go into buckets.
A bucket holds the keys that share their first bits; one that is overfull is split by its next bit,
and when no bucket is left at the greatest depth, the directory doubles. Buckets are first cut at the
depth their total size asks for, so few doublings follow, each over the overfull buckets' keys only.
Equal keys can never be split: a single key beyond a bucket's bound gets overflow pages instead, so
copies of one text may be a third of all rows.

Files below the index folder: ``directory`` (a row per bucket: its first key, depth, load and pages)
and ``buckets`` (rows with their normalised texts, written by the task that owns the bucket's range of
keys, page by page). The owners' files are then read back and texts of equal keys are compared byte by
byte: a key with several texts is a collision, and each of its texts is a chain link of its own.

Null texts equal empty ones. Of equal texts the row with the smallest id stays, a null id after all
others; of repeated rows of that id one stays. An empty table has no groups. Other columns are not
read, so their names may clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.operators.ordered import join_hot
from keystride.params import MAX_BROADCAST_ROWS
from keystride.session import materialize, work_dir

BUCKET_BYTES = 4 << 20   # normalised text of a bucket or page
BUCKET_ROWS = 1024       # rows of a bucket or page
KEY_BITS = 64
# Runs that are not one space already: the same result as replacing every run, with fewer matches.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


@dataclass
class Index:
    """Keys of all texts, and where the rows of repeated keys lie."""

    keys: DataFrame       # key, n, n_bytes, doc_id, sha lanes
    directory: DataFrame  # bucket, depth, n_keys, n_rows, n_bytes, pages
    buckets: DataFrame    # doc_id, key, norm, text_sha256, bucket, page, uid


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def _lanes(digest: Column) -> list[Column]:
    """Four integers of a hex digest, so that it can be aggregated by hashing."""
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"sha{i}") for i in range(4)]


def _digest() -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)]))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key_bits: int = KEY_BITS) -> DataFrame:
    """``doc_id, norm, key, text_sha256``. Fewer ``key_bits`` make more collisions, with the same groups."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("norm"))
    key = F.shiftleft(F.xxhash64("norm"), KEY_BITS - key_bits) if key_bits < KEY_BITS else F.xxhash64("norm")
    return rows.withColumn("key", key).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))


def _prefix(depth: int) -> Column:
    """First key of the bucket at a depth: the key's first bits, zeros after."""
    if depth == 0:
        return F.lit(0).cast("bigint")
    return F.shiftleft(F.shiftrightunsigned("key", KEY_BITS - depth), KEY_BITS - depth)


def split_buckets(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``bucket, depth, pages`` to distinct keys (``key, n, n_bytes``) by doubling the directory.

    No bucket of several keys exceeds the bounds; all keys are apart at the depth of their bits.
    """
    total = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("r")).first()
    fill = max(total.b / bucket_bytes, total.r / bucket_rows, 1.0)
    depth, overfull, placed = math.ceil(math.log2(fill)), keys, []
    names = [*keys.columns, "bucket", "depth", "pages"]
    while True:
        # Distinct keys are evenly spread, and no more than an overfull bucket's meet here.
        mates = Window.partitionBy("bucket")
        load = F.greatest(F.sum("n_bytes").over(mates) / bucket_bytes, F.sum("n").over(mates) / bucket_rows)
        sized = overfull.withColumn("bucket", _prefix(depth)).withColumn("depth", F.lit(depth)).withColumn(
            "_load", load).withColumn("_held", F.count(F.lit(1)).over(mates))
        sized = materialize(sized.withColumn("pages", F.greatest(F.ceil("_load"), F.lit(1)).cast("int")))
        placed.append(sized.where((F.col("_load") <= 1) | (F.col("_held") == 1)).select(*names))
        overfull = sized.where((F.col("_load") > 1) & (F.col("_held") > 1)).select(*keys.columns)
        depth += 1
        if depth > KEY_BITS or overfull.isEmpty():
            return reduce(DataFrame.unionByName, placed)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
          bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, key_bits: int = KEY_BITS) -> Index:
    """Write the index of ``docs`` and return it."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "hash-index")
    rows = keyed(docs, doc_id, text, key_bits)
    keys = materialize(
        rows.select("key", "doc_id", F.octet_length("norm").alias("size"), *_lanes(F.col("text_sha256")))
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_bytes"), F.min("doc_id").alias("doc_id"),
                            *[F.min(f"sha{i}").alias(f"sha{i}") for i in range(4)]))
    placed = materialize(split_buckets(keys.where("n > 1").select("key", "n", "n_bytes"), bucket_bytes, bucket_rows))
    placed.groupBy("bucket", "depth").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"),
        F.max("pages").alias("pages")).write.parquet(f"{folder}/directory")
    home = placed.select("key", "bucket", "pages")
    # Beyond the bound texts are shuffled to their keys; a hot key's part is split by the skewed join.
    repeated = rows.join(F.broadcast(home), "key") if home.count() <= MAX_BROADCAST_ROWS else rows.hint("merge").join(home, "key")
    # The input split deals out repeated rows of one id; a lost task finds the same one again.
    page = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("pages")).cast("int")
    owned = repeated.withColumn("page", page).drop("pages").repartition("bucket", "page")
    owned.sortWithinPartitions("bucket", "page", "key").withColumn(
        "uid", F.monotonically_increasing_id()).write.parquet(f"{folder}/buckets")
    return Index(keys, spark.read.parquet(f"{folder}/directory"), spark.read.parquet(f"{folder}/buckets"))


def chains(index: Index) -> DataFrame:
    """``key, chain, keep_id, group_size`` of every text in the buckets; a collided key has several.

    Owners' tasks fold the copies in their files, so one text per file and chain is shuffled.
    """
    return index.buckets.groupBy("key", "norm").agg(
        F.min("uid").alias("chain"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: Index | None = None, **bounds) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``."""
    index = index or build(docs, doc_id, text, **bounds)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = index.keys.where("n = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        _digest().alias("text_sha256"))
    links = materialize(chains(index).select("key", "chain", "keep_id", "group_size"))
    collided = materialize(links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    rows = index.buckets.select("uid", "doc_id", "key", "text_sha256")
    if collided.isEmpty():
        linked = join_hot(rows, links, ["key"])
    else:
        texts = join_hot(index.buckets.select("uid", "doc_id", "key", "text_sha256", "norm"), collided, ["key"])
        apart = join_hot(index.buckets.select("key", "norm", "uid", "doc_id"), collided, ["key"]).groupBy("key", "norm").agg(
            F.min("uid").alias("chain"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        single = links.join(collided, "key", "left_anti")
        linked = join_hot(rows, single, ["key"]).unionByName(join_hot(texts, apart, ["key", "norm"]).drop("norm"))
    linked = materialize(linked)
    # Of repeated rows of the smallest id the first in the files stays.
    first = linked.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("chain").agg(F.min("uid").alias("first"))
    placed = join_hot(linked, materialize(first), ["chain"])
    return alone.unionByName(placed.withColumn("kept", F.col("uid") == F.col("first")).select(*out))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs`` that stay, with ``group_size`` and ``text_sha256`` in place of their other columns."""
    return group(docs, doc_id, text, **bounds).where("kept").drop("kept", "keep_id")
