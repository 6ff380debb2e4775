"""Tables written batch by batch: each attempt in a folder of its own, named by a commit row once complete.

Layout below the root:
``data/batch_id=N/attempt=A``  rows of one attempt to write batch N
``commits``                    a row (``batch_id``, ``attempt``) per committed batch
Readers use the attempts that commit rows name. A batch that is written again after its commit changes
nothing; one that failed before it leaves files nobody reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from keystride.operators.ordered import join_hot
from keystride.session import empty_table

_COMMIT = "batch_id bigint, attempt string"


def read_or_empty(spark: SparkSession, schema: T.StructType | str, path: str) -> DataFrame:
    """Rows of a folder, none if it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return empty_table(spark, schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a store, wherever Spark's file systems keep it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class BatchTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def commits(self) -> DataFrame:
        """``batch_id, attempt``; of two attempts that committed at once the smaller name counts."""
        rows = read_or_empty(self.spark, _COMMIT, f"{self.root}/commits")
        return rows.groupBy("batch_id").agg(F.min("attempt").alias("attempt"))

    def holds(self, batch_id: int) -> bool:
        return not self.commits().where(F.col("batch_id") == batch_id).isEmpty()

    def last(self) -> int | None:
        return self.commits().agg(F.max("batch_id")).first()[0]

    def write(self, rows: DataFrame, batch_id: int) -> bool:
        """Publish a batch; False if it has been published before."""
        if self.holds(batch_id):
            return False
        attempt = uuid.uuid4().hex
        rows.select(*self.schema.names).write.parquet(f"{self.root}/data/batch_id={batch_id}/attempt={attempt}")
        named = self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(attempt).alias("attempt"))
        named.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def read(self, after: int | None = None, through: int | None = None) -> DataFrame:
        """Rows of the committed batches in a range, with ``batch_id``."""
        named = self.commits()
        if after is not None:
            named = named.where(F.col("batch_id") > after)
        if through is not None:
            named = named.where(F.col("batch_id") <= through)
        fields = [*self.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType())]
        rows = read_or_empty(self.spark, T.StructType(fields), f"{self.root}/data")
        # A row per batch. The bounds on the folder's own column prune folders.
        if after is not None:
            rows = rows.where(F.col("batch_id") > after)
        if through is not None:
            rows = rows.where(F.col("batch_id") <= through)
        return join_hot(rows, named, ["batch_id", "attempt"]).drop("attempt")

    def vacuum(self, before: int) -> None:
        """Remove the data of batches below ``before``, which a compaction has made superfluous."""
        for row in self.commits().where(F.col("batch_id") < before).select("batch_id").toLocalIterator():
            remove(self.spark, f"{self.root}/data/batch_id={row.batch_id}")
