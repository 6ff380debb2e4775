"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keystride.params import MAX_BROADCAST_ROWS
from keystride.session import materialize

BATCH_BYTES = 8 * 1024 * 1024
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's code to the workers, once per context, as ``--py-files`` would.

    The driver only packs the sources; Spark hands the archive to every executor.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(context, "_keystride_shipped", False) or not os.path.isdir(root):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="keystride-code-"), "keystride_code.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._keystride_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small enough for a Python worker; never raises a setting."""
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name)  # the byte bound may carry a unit; then it is set anew
        if not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(name, str(bound))


def map_columns(
    df: DataFrame, inputs: list[Column], keep: list[str], added: str, make: Callable[[], Callable[..., list[pa.Array]]]
) -> DataFrame:
    """Keep columns of ``df`` and add columns that a function computes batch by batch.

    ``make`` runs once in each task and returns the function; it gets one Arrow array per input
    column and returns one per field of the DDL string ``added``. Columns are addressed by place, so
    names may clash with those of ``df`` that are not kept.
    """
    fields = T.StructType.fromDDL(added)
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    arrow = to_arrow_schema(schema)
    n = len(keep)
    placed = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                       *[c.alias(f"i{i}") for i, c in enumerate(inputs)])
    ship(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows:
                got = list(batch.columns[:n]) + compute(*batch.columns[n:])
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                del got, columns, batch
        pa.default_memory_pool().release_unused()  # the worker lives on

    return placed.mapInArrow(run, schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold -1, so it is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1).cast("bigint"))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``key``; all rows if there are fewer."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(most)


def connected_components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``edges`` (``a, b``): equal roots, same component.

    Randomised contraction: in each round every vertex joins the neighbour (or itself) with the
    smallest hash, edges are rewritten and made distinct, and a constant share of the vertices is
    gone, whatever the diameter. Neighbours are only reduced to a minimum, so a hub costs no more
    than its rows. Each round is written to the shared folder.
    """
    edges = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        turn = F.lit(len(levels))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hashed = lambda c: F.struct(F.xxhash64(turn, F.col(c)).alias("h"), F.col(c).alias("v"))
        joined = both.groupBy("a").agg(F.min(hashed("b")).alias("m"))
        joined = materialize(joined.select(F.col("a").alias("v"), F.least(hashed("a"), F.col("m"))["v"].alias("to")))
        levels.append(joined)
        left = joined.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        right = joined.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta <> tb")
        edges = materialize(
            moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    labels = levels[-1].select("v", F.col("to").alias("root"))
    for joined in reversed(levels[:-1]):
        later = labels.select(F.col("v").alias("to"), "root")
        labels = joined.join(later, "to", "left").select("v", F.coalesce("root", "to").alias("root"))
    return materialize(labels)


def digest_lanes(digest: Column, lanes: int) -> list[Column]:
    """The first 16 * ``lanes`` hex digits as integers, which aggregate and join by hashing."""
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(lanes)]


def meet(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join rows with keys that repeat to a table with a row per key, none of them null.

    A counted small table is broadcast; beyond that the merge join's hot partitions are split as it runs.
    """
    if right.count() <= max_broadcast:
        return left.join(F.broadcast(right), by, how)
    return left.hint("merge").join(right, by, how)
