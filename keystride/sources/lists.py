"""Stored suggestion lists laid out by key.

A version of the store is a bucketed table: its files hold ranges of the keys' hash, sorted by key, and
Spark knows it. A join on the key therefore reads the buckets as they lie and shuffles only the requests.

Layout below the root:
``data/attempt=A``  the lists of one write, a file per bucket
``versions``        a row per complete write: its attempt and its number of buckets
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystride.session import empty_table
from keystride.sources.batches import read_or_empty, remove

LISTS = T.StructType([
    T.StructField("cache_key", T.StringType()),
    T.StructField("node", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("expires_at", T.TimestampType()),
])
BUCKETS = 64
_VERSION = "version bigint, attempt string, buckets int"


class ListStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def _versions(self) -> DataFrame:
        return read_or_empty(self.spark, _VERSION, f"{self.root}/versions")

    def _path(self, attempt: str) -> str:
        return f"{self.root}/data/attempt={attempt}"

    def write(self, lists: DataFrame) -> None:
        """Replace the store's lists. Buckets grow with the lists, so ``buckets`` is chosen by their size."""
        attempt = uuid.uuid4().hex
        # As many partitions as buckets, by the same hash: each task writes one bucket.
        placed = lists.select(*LISTS.names).repartition(self.buckets, "cache_key")
        placed.write.format("parquet").bucketBy(self.buckets, "cache_key").sortBy("cache_key").option(
            "path", self._path(attempt)).saveAsTable(self._table(attempt))
        newest = self._versions().agg(F.max("version")).first()[0]
        row = self.spark.range(1).select(F.lit(0 if newest is None else newest + 1).cast("bigint").alias("version"),
                                         F.lit(attempt).alias("attempt"), F.lit(self.buckets).alias("buckets"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    @staticmethod
    def _table(attempt: str) -> str:
        return f"keystride_lists_{attempt}"

    def read(self) -> DataFrame:
        """The newest lists, whichever session wrote them."""
        row = self._versions().orderBy(F.desc("version"), "attempt").first()
        if row is None:
            return empty_table(self.spark, LISTS)
        name = self._table(row.attempt)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTS)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cache_key) SORTED BY (cache_key) "
                           f"INTO {row.buckets} BUCKETS LOCATION '{self._path(row.attempt)}'")
        return self.spark.table(name)

    def vacuum(self) -> None:
        """Remove all but the newest lists."""
        rows = self._versions().orderBy(F.desc("version"), "attempt").collect()  # a row per write
        for row in rows[1:]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(row.attempt)}")
            remove(self.spark, self._path(row.attempt))
