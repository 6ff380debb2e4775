"""SimHash near-duplicates found by multi-index hashing.

Fingerprints: 64 bits over the XXH64 values of 3-word shingles, repeats counted; a bit is set if it is
set in more than half of them. A text with fewer words is one shingle, a text without words (null
too) has fingerprint zero and is linked like any other.

Search: texts that share a fingerprint are one vertex, so copies never meet as pairs. A fingerprint
is cut into ``segments``; if two differ in at most ``radius`` bits, they differ in at most
``radius // segments`` bits of some segment, so every value in that small ball around each segment is
looked up in a table of the segments as they are, and the full distance is verified within the join.
With two segments of 32 bits a look-up meets chance candidates only once tables hold billions of
fingerprints. Each pair is looked up from its smaller member. Nothing is capped.

The class of a text is the smallest id that links reach. Null ids are passed over; a class with null
ids only has a null class id. Repeated rows are kept, each with its class.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.llm.common import connected_components, map_columns
from keystride.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 3
SEGMENTS = 2
BITS = 64
HASHES_AT_ONCE = 1 << 16
# What separates words.
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one whole text."""
    from xxhash import xxh64_intdigest

    # Bytes: lower() touches A-Z only and split() knows just the six ASCII spaces.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
        n = len(words) - shingle + 1
    hashes = map(partial(xxh64_intdigest, seed=seed), grams)
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, HASHES_AT_ONCE):
        h = np.fromiter(hashes, dtype=">u8", count=min(HASHES_AT_ONCE, n - start))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns and ``fingerprint bigint``."""
    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())]

        return compute

    return map_columns(docs, [F.col(f"`{text}`").cast("string")], keep, "fingerprint bigint", make)


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def near_pairs(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``a, b`` with ``a < b``: all pairs of distinct fingerprints at most ``radius`` bits apart.

    A pair close in several segments comes several times.
    """
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    within = radius // segments
    tables, looks = [], []
    for s, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        width = high - low
        if width > 56:
            raise ValueError("segments must leave room for their number")
        value = F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(s << width if s else 0).cast("bigint")
        tables.append(value.bitwiseOR(tag))
        looks += [value.bitwiseXOR(F.lit(m).cast("bigint")).bitwiseOR(tag) for m in ball(width, within)]
    table = distinct.select(F.col("fingerprint").alias("b"), F.explode(F.array(*tables)).alias("key"))
    look = distinct.select(F.col("fingerprint").alias("a"), F.explode(F.array(*looks)).alias("key"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = look.hint("merge").join(table, (look["key"] == table["key"]) & (F.col("a") < F.col("b")) & (apart <= radius))
    return met.select("a", "b")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, segments: int = SEGMENTS,
          keep: list[str] | None = None) -> DataFrame:
    """Kept columns, ``fingerprint bigint, component_id, root``; one row per row of ``docs``.

    ``root`` is a fingerprint of the class and never null.
    """
    keep = [doc_id] if keep is None else keep
    prints = materialize(fingerprints(docs, keep, text))
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min(f"`{doc_id}`").alias("least")))
    pairs = materialize(near_pairs(distinct.select("fingerprint"), radius, segments))
    roots = connected_components(pairs).withColumnRenamed("v", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only linked fingerprints need the look-up by root; the others have their own smallest id.
    linked = roots.join(least, "root").select("fingerprint", "root", "component_id")
    own = materialize(distinct.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"),
        F.coalesce("component_id", "least").alias("component_id")))
    # A fingerprint may hold a third of all rows; its partition is split by the skewed join.
    return prints.hint("merge").join(own, "fingerprint").select(
        *[F.col(f"`{c}`") for c in keep], "fingerprint", "component_id", "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
             segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each class the row with the smallest id stays.

    Of rows that share id and text one stays; a class with null ids only keeps one row.
    """
    ids, texts = F.col(f"`{doc_id}`"), F.col(f"`{text}`")

    def key(id_: Column, row: Column) -> list[Column]:
        """What a row is told by: its id, whether it has one, and its hash."""
        return [F.coalesce(id_.cast("string"), F.lit("")).alias("_key"), id_.isNull().alias("_none"), row.alias("_row")]

    row = F.xxhash64(ids, texts)
    named = docs.select(ids.alias("_id"), texts.alias("_text"), row.alias("_row"))
    classes = group(named, "_id", "_text", radius, segments, keep=["_id", "_row"])
    ranked = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    kept = classes.groupBy("root").agg(F.min(ranked).alias("m")).select(*key(F.col("m.i"), F.col("m.r")))
    # The row is one column, so no name of it can clash. Join and numbering share one shuffle of the rows.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *key(ids, row))
    by = ["_key", "_none", "_row"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    return rows.join(kept, by, "left_semi").withColumn("_n", first).where("_n = 1").select("_doc.*")
