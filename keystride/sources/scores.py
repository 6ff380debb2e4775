"""The stored score table: a new version per update, named by a row once it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.operators import trending
from keystride.params import HALF_LIFE_SECONDS
from keystride.session import empty_table
from keystride.sources.batches import BatchTable

SCORE = "query_norm string, score double, level double, ref_ts timestamp"


class ScoreStore:
    """Versions are the batches of a batch table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.table = BatchTable(spark, f"{self.root}/scores", SCORE)

    def version(self) -> int | None:
        return self.table.last()

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            return empty_table(self.spark, SCORE)
        return self.table.read(after=version - 1, through=version).drop("batch_id")

    def write(self, scores: DataFrame, version: int) -> None:
        self.table.write(trending.with_level(scores), version)

    def add(self, events: DataFrame, as_of: trending.Moment, half_life: float = HALF_LIFE_SECONDS,
            batch_id: int | None = None) -> int:
        """Add new events to the stored scores at a common reference time; returns the new version.

        With ``batch_id``, which must grow from batch to batch, the version takes that number, and a batch
        that is added again changes nothing.
        """
        version = self.version()
        if batch_id is not None and version is not None and batch_id <= version:
            return version
        new = trending.decayed_scores(events, as_of, half_life)
        number = batch_id if batch_id is not None else 0 if version is None else version + 1
        self.write(new if version is None else trending.add_scores(self.read(), new, as_of, half_life), number)
        return number

    def vacuum(self) -> None:
        """Remove all versions but the newest."""
        version = self.version()
        if version is not None:
            self.table.vacuum(version)
