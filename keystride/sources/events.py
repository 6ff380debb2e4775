"""The search-event log: append and read, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("q", T.StringType()),
    T.StructField("d", T.StringType()),
])


def append_events(events: DataFrame, path: str) -> None:
    """Append to the log, partitioned by day so that readers prune by date."""
    dated = events.select(*EVENT.names, F.to_date("ts").alias("day"))
    dated.write.mode("append").partitionBy("day").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(path)


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The log as a stream, from its start; progress is kept in the query's checkpoint."""
    reader = spark.readStream.schema(EVENT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_events_kafka(spark: SparkSession, servers: str, topic: str, min_events: int = 500,
                        max_delay: str = "5s", max_events: int | None = None) -> DataFrame:
    """The log as a Kafka stream; needs Spark's Kafka connector on the class path.

    A micro-batch starts after ``min_events`` or ``max_delay``, whichever comes first. The message
    value is JSON with ``q`` and ``d``; partition and offset make the event's identity.
    """
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("minOffsetsPerTrigger", min_events)
        .option("maxTriggerDelay", max_delay)
    )
    if max_events:
        reader = reader.option("maxOffsetsPerTrigger", max_events)
    body = F.from_json(F.col("value").cast("string"), "q string, d string")
    identity = F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")
    return reader.load().select(
        identity.alias("event_id"), F.col("timestamp").alias("ts"), body["q"].alias("q"), body["d"].alias("d")
    )
