"""The stored dictionary: versioned base, one delta per micro-batch, commit rows.

Layout below the root:
``base/version=V/attempt=A``  whole dictionary, laid out by normal form
``versions``                  a row per complete base: its attempt and the last batch contained in it
``deltas``                    deltas of the micro-batches, see ``batches``
Readers use what a commit or version row names, so they never see half of a write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.operators.merge import DICTIONARY, upsert
from keystride.operators.prefix import sort_for_prefixes
from keystride.session import empty_table
from keystride.sources.batches import BatchTable, read_or_empty, remove

_VERSION = "version bigint, attempt string, through bigint"


class DictionaryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.deltas = BatchTable(spark, f"{self.root}/deltas", DICTIONARY)

    def _versions(self) -> DataFrame:
        """A row per version; of two runs that took one number the smaller attempt counts."""
        rows = read_or_empty(self.spark, _VERSION, f"{self.root}/versions")
        return rows.groupBy("version").agg(F.min(F.struct("attempt", "through")).alias("a")).select("version", "a.*")

    def _current(self) -> tuple[int | None, str | None, int]:
        """Newest version, its attempt and the last batch it contains."""
        row = self._versions().agg(F.max(F.struct("version", "attempt", "through")).alias("v")).first()
        return (row.v.version, row.v.attempt, row.v.through) if row and row.v else (None, None, -1)

    def _write_base(self, rows: DataFrame, version: int, through: int) -> None:
        attempt = uuid.uuid4().hex
        laid_out = sort_for_prefixes(rows.select(*DICTIONARY.names)).sortWithinPartitions("query_norm", "query")
        laid_out.write.parquet(f"{self.root}/base/version={version}/attempt={attempt}")
        named = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"), F.lit(attempt).alias("attempt"),
            F.lit(through).cast("bigint").alias("through"))
        named.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    def is_empty(self) -> bool:
        return self.base().isEmpty() and self.pending().isEmpty()

    def load_if_empty(self, rows: DataFrame) -> bool:
        """First load; does nothing and returns False once any row exists."""
        if not self.is_empty():
            return False
        self._write_base(rows, 0, -1)
        return True

    def commit(self, deltas: DataFrame, batch_id: int) -> None:
        """Publish one micro-batch; a batch that is published already stays as it is."""
        self.deltas.write(deltas, batch_id)

    def _base_of(self, version: int | None, attempt: str | None) -> DataFrame:
        if version is None:
            return empty_table(self.spark, DICTIONARY)
        return self.spark.read.schema(DICTIONARY).parquet(f"{self.root}/base/version={version}/attempt={attempt}")

    def base(self, version: int | None = None) -> DataFrame:
        """The whole dictionary as of the newest (or the given) version, laid out by normal form."""
        if version is None:
            version, attempt, _ = self._current()
        else:
            attempt = self._versions().where(F.col("version") == version).first().attempt
        return self._base_of(version, attempt)

    def pending(self, through: int | None = None) -> DataFrame:
        """Committed deltas the base does not contain yet, with their ``batch_id``."""
        if through is None:
            through = self._current()[2]
        return self.deltas.read(after=through)

    def read(self) -> DataFrame:
        """Base and pending deltas of one moment, merged."""
        version, attempt, through = self._current()
        return upsert(self._base_of(version, attempt), self.pending(through).drop("batch_id"))

    def compact(self) -> int:
        """Write base and pending deltas as the next version; returns its number."""
        version, attempt, through = self._current()
        last = self.deltas.last()
        last = through if last is None else max(last, through)
        number = 0 if version is None else version + 1
        # What is committed while this runs is left out.
        deltas = self.deltas.read(after=through, through=last)
        self._write_base(upsert(self._base_of(version, attempt), deltas.drop("batch_id")), number, last)
        return number

    def vacuum(self, before: int) -> None:
        """Remove versions below ``before`` and the deltas that the oldest kept version contains."""
        kept = self._versions().where(F.col("version") >= before).agg(F.min("through")).first()[0]
        if kept is None:
            return
        for row in self._versions().where(F.col("version") < before).select("version").toLocalIterator():
            remove(self.spark, f"{self.root}/base/version={row.version}")
        self.deltas.vacuum(kept + 1)
