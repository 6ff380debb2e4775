"""Tables kept in key ranges, of which a change rewrites only those it meets.

Layout below the root:
``data/attempt=A/range_id=R``  rows of one range as one attempt wrote them, sorted by key
``manifest/attempt=A``         a row per range: its lowest key, its rows, the attempt that wrote it
``versions``                   a row per complete version: its attempt and the last batch contained in it
A merge reads and writes the ranges its keys fall in; the new manifest names all other ranges' files as
they are. A range that has grown too large is cut again by its own keys, so ranges stay of one size.
Readers use what a version row names. There is one writer at a time; a batch that is merged again
changes nothing.

What reaches the driver is the manifest of the ranges in use, a row for ``target_rows`` rows of the table.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keystride.operators.merge import DICTIONARY, upsert
from keystride.session import empty_table, materialize
from keystride.sources.batches import read_or_empty, remove

_MANIFEST = "range_id string, low string, n_rows bigint, attempt string"
_VERSION = "version bigint, attempt string, through bigint"
TARGET_ROWS = 1_000_000
_LAST = "\U0010ffff"  # no key's text continues with it


class RangeTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: str, target_rows: int = TARGET_ROWS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.key = key
        self.target_rows = target_rows

    # -- versions -------------------------------------------------------------------------------

    def _current(self) -> Row | None:
        rows = read_or_empty(self.spark, _VERSION, f"{self.root}/versions")
        # Of two runs that took one number the smaller attempt counts.
        return rows.orderBy(F.desc("version"), "attempt").first()

    def through(self) -> int:
        """Last batch that is contained, -1 if there is none."""
        current = self._current()
        return -1 if current is None else current.through

    def manifest(self, attempt: str | None = None) -> DataFrame:
        """``range_id, low, n_rows, attempt`` of the newest version."""
        if attempt is None:
            current = self._current()
            if current is None:
                return empty_table(self.spark, _MANIFEST)
            attempt = current.attempt
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/attempt={attempt}")

    def _commit(self, manifest: DataFrame, attempt: str, through: int) -> None:
        manifest.coalesce(1).write.parquet(f"{self.root}/manifest/attempt={attempt}")
        current = self._current()
        number = 0 if current is None else current.version + 1
        named = self.spark.range(1).select(
            F.lit(number).cast("bigint").alias("version"), F.lit(attempt).alias("attempt"),
            F.lit(through).cast("bigint").alias("through"))
        named.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    # -- reading --------------------------------------------------------------------------------

    def _ranges(self) -> list[Row]:
        """The manifest in the order of keys, as Spark compares texts."""
        return sorted(self.manifest().collect(), key=lambda r: r.low.encode())

    def _read(self, ranges: list[Row]) -> DataFrame:
        paths = [f"{self.root}/data/attempt={r.attempt}/range_id={r.range_id}" for r in ranges if r.n_rows]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else empty_table(self.spark, self.schema)

    def read(self) -> DataFrame:
        return self._read(self._ranges())

    def read_starting(self, prefix: str) -> DataFrame:
        """The ranges that may hold keys with this beginning; no other file is read."""
        ranges = self._ranges()
        lows = [r.low.encode() for r in ranges]
        first, last = (max(0, bisect_right(lows, p.encode()) - 1) for p in (prefix, prefix + _LAST))
        return self._read(ranges[first:last + 1])

    def _placed(self, rows: DataFrame, ranges: list[Row], keys: list[tuple[str, Column]]) -> DataFrame:
        """Add the number of the range each key falls in, null keys as the smallest.

        A key is first told its block of ranges, then joined to the block's ranges: twice the root of
        the number of ranges is compared, not all of them.
        """
        step = max(1, math.isqrt(len(ranges)))
        starts = F.array(*[F.lit(r.low) for r in ranges[::step]])
        table = self.manifest().select("low").withColumn("high", F.lead("low").over(Window.orderBy("low"))).withColumn(
            "number", F.row_number().over(Window.orderBy("low")) - 1)  # a row per range
        block = F.floor(F.col("number") / step)
        for name, key in keys:
            bounds = table.select(block.alias("_block"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("number").alias(name))
            asked = rows.withColumn("_key", F.coalesce(key, F.lit(""))).withColumn(
                "_block", (F.size(F.filter(starts, lambda s: s <= F.col("_key"))) - 1).cast("bigint"))
            within = (F.col("_key") >= F.col("_low")) & (F.col("_high").isNull() | (F.col("_key") < F.col("_high")))
            rows = asked.join(F.broadcast(bounds), "_block").where(within).drop("_block", "_key", "_low", "_high")
        return rows

    def read_for(self, keys: DataFrame, key: str, beginnings: bool = False) -> DataFrame:
        """The ranges in which some of ``keys`` fall, or keys that begin with them may."""
        ranges = self._ranges()
        if not ranges:
            return empty_table(self.spark, self.schema)
        wanted = [("_from", F.col(key)), ("_to", F.concat(F.col(key), F.lit(_LAST)) if beginnings else F.col(key))]
        met = self._placed(keys.select(key), ranges, wanted).select(F.explode(F.sequence("_from", "_to")).alias("n")).distinct()
        return self._read([ranges[r.n] for r in met.collect()])

    # -- writing --------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, range_id: Column, attempt: str) -> DataFrame:
        """Write rows that lie with their range's in one partition; the manifest rows of what was written."""
        path = f"{self.root}/data/attempt={attempt}"
        named = rows.select(*self.schema.names, range_id.alias("range_id"))
        named.sortWithinPartitions("range_id", self.key).write.mode("append").partitionBy("range_id").parquet(path)
        found = read_or_empty(self.spark, T.StructType([*self.schema.fields, T.StructField("range_id", T.StringType())]), path)
        return found.groupBy("range_id").agg(
            F.coalesce(F.min(self.key), F.lit("")).alias("low"), F.count(F.lit(1)).alias("n_rows"))

    def _cut(self, rows: DataFrame, n_rows: int, name: str, attempt: str) -> list[tuple]:
        """Write ``rows`` as ranges of about the target size; equal keys stay together."""
        parts = max(1, math.ceil(n_rows / self.target_rows))
        laid = rows.repartitionByRange(parts, self.key)
        written = self._write(laid, F.concat(F.lit(name), F.spark_partition_id().cast("string")), attempt)
        return [(r.range_id, r.low, r.n_rows) for r in written.where(F.startswith("range_id", F.lit(name))).collect()]

    def load(self, rows: DataFrame, through: int = -1) -> None:
        """Replace the whole table."""
        rows = materialize(rows.select(*self.schema.names))
        attempt = uuid.uuid4().hex
        made = sorted(self._cut(rows, rows.count(), "r", attempt), key=lambda r: r[1].encode()) or [("r0", "", 0)]
        made[0] = (made[0][0], "", made[0][2])  # the first range begins below every key
        self._commit(self._as_manifest(made, attempt), attempt, through)

    def _as_manifest(self, made: list[tuple], attempt: str) -> DataFrame:
        return self.spark.createDataFrame([(*m, attempt) for m in made], _MANIFEST)

    def merge(self, changes: DataFrame, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame],
              through: int | None = None) -> bool:
        """Rewrite the ranges that ``changes`` meet as ``combine(their rows, changes)``.

        ``combine`` returns the new rows of these ranges; it must not move a row to another range. False
        if batch ``through`` is contained already.
        """
        current = self._current()
        if current is None:
            self.load(empty_table(self.spark, self.schema))
            current = self._current()
        if through is not None and through <= current.through:
            return False
        through = current.through if through is None else through
        ranges = self._ranges()
        changes = materialize(changes)
        placed = self._placed(changes.select(key), ranges, [("_number", F.col(key))])
        touched = sorted(r["_number"] for r in placed.select("_number").distinct().collect())
        attempt = uuid.uuid4().hex
        made = []
        if touched:
            rows = combine(self._read([ranges[n] for n in touched]), changes)
            numbered = self._placed(rows, ranges, [("_number", F.col(self.key))])
            # A range's rows meet in one task: no more than twice the target, and what was added.
            label = F.concat(F.lit("m"), F.col("_number").cast("string"))
            written = {r.range_id: r.n_rows for r in self._write(numbered.repartition("_number"), label, attempt).collect()}
            for n in touched:
                count, low = written.get(f"m{n}", 0), ranges[n].low
                if count > 2 * self.target_rows:
                    whole = self._read([Row(range_id=f"m{n}", attempt=attempt, n_rows=count)])
                    cut = sorted(self._cut(whole, count, f"m{n}-", attempt), key=lambda r: r[1].encode())
                    made += [(cut[0][0], low, cut[0][2]), *cut[1:]]
                    remove(self.spark, f"{self.root}/data/attempt={attempt}/range_id=m{n}")
                else:
                    made.append((f"m{n}", low, count))
        kept = [r for n, r in enumerate(ranges) if n not in set(touched)]
        manifest = self.spark.createDataFrame([(r.range_id, r.low, r.n_rows, r.attempt) for r in kept] + [(*m, attempt) for m in made], _MANIFEST)
        self._commit(manifest, attempt, through)
        return True

    def vacuum(self) -> None:
        """Remove the files of ranges that the newest version no longer names."""
        current = self._current()
        if current is None:
            return
        kept = self.manifest(current.attempt).select("range_id", "attempt")
        for old in read_or_empty(self.spark, _VERSION, f"{self.root}/versions").where(F.col("attempt") != current.attempt).select("attempt").distinct().collect():
            named = read_or_empty(self.spark, _MANIFEST, f"{self.root}/manifest/attempt={old.attempt}").select("range_id", "attempt")
            for r in named.join(kept, ["range_id", "attempt"], "left_anti").toLocalIterator():
                remove(self.spark, f"{self.root}/data/attempt={r.attempt}/range_id={r.range_id}")
            remove(self.spark, f"{self.root}/manifest/attempt={old.attempt}")


class DictionaryRanges(RangeTable):
    """The dictionary in ranges of its normal forms; its upsert rewrites the ranges that deltas meet."""

    def __init__(self, spark: SparkSession, root: str, target_rows: int = TARGET_ROWS):
        super().__init__(spark, root, DICTIONARY, "query_norm", target_rows)

    def upsert(self, deltas: DataFrame, batch_id: int | None = None) -> bool:
        """Add deltas in the dictionary's shape, whose normal forms are those of their queries."""
        return self.merge(deltas.select(*self.schema.names), "query_norm", upsert, batch_id)

    def rows_of(self, changed: DataFrame) -> DataFrame:
        """The rows, as they are now, of the queries in ``changed`` (``query, query_norm``)."""
        names = changed.select("query", "query_norm").distinct()
        return self.read_for(names, "query_norm").join(names.select("query"), "query", "left_semi")
