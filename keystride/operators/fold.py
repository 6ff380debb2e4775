"""Search events: validation, flush replay, folding into per-query deltas.

Raw event columns: ``event_id``, ``ts``, ``q`` (query), ``d`` (display, may be missing).
Clean event columns: ``event_id``, ``ts``, ``query_norm``, ``display``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.functions import scoring, text
from keystride.operators.ordered import row_numbers
from keystride.params import (
    FLUSH_INTERVAL_SECONDS, FLUSH_THRESHOLD, MAX_GROUP_ROWS, MAX_QUERY_LENGTH,
)

FLUSH = ["flush_window", "flush_chunk"]


def check_requests(requests: DataFrame, column: str = "query", limit: int = MAX_QUERY_LENGTH) -> DataFrame:
    """Add ``error``: null for a valid request, else every violated rule."""
    return requests.withColumn("error", text.query_error(F.col(column), limit))


def to_event(requests: DataFrame, column: str = "query") -> DataFrame:
    """Turn valid requests into events: ``q`` normalized, ``d`` stripped with its case kept."""
    return (
        requests.withColumn("q", text.normalize(F.col(column)))
        .withColumn("d", text.strip(F.col(column)))
        .drop(column)
    )


def usable_events(events: DataFrame) -> DataFrame:
    """Drop events without a query; an event without a display shows its query."""
    return events.where(F.col("q").isNotNull()).withColumnsRenamed({"q": "query_norm"}).withColumn(
        "display", F.coalesce("d", "query_norm")
    ).drop("d")


def unusable_events(events: DataFrame) -> DataFrame:
    """What ``usable_events`` leaves out, kept for inspection."""
    return events.where(F.col("q").isNull())


def assign_flushes(events: DataFrame, threshold: int = FLUSH_THRESHOLD,
                   interval_seconds: int = FLUSH_INTERVAL_SECONDS,
                   max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add ``flush_window`` (start second) and ``flush_chunk``.

    A flush closes after ``threshold`` events or when its time window ends, whichever comes first.
    """
    width = interval_seconds * 1_000_000
    micros = F.unix_micros("ts")
    windowed = events.withColumn("flush_window", ((micros - F.pmod(micros, F.lit(width))) / F.lit(1_000_000)).cast("bigint"))
    numbered = row_numbers(windowed, ["flush_window"], [F.asc("ts"), F.asc("event_id")], "_n", max_group_rows)
    chunk = F.floor((F.col("_n") - 1) / F.lit(threshold))
    return numbered.withColumn("flush_chunk", chunk).drop("_n")


def fold(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group and query: ``delta``, the first display, first and last time.

    Partial sums are formed before the shuffle, so a hot query costs one row per task.
    """
    first = F.struct("ts", "event_id")
    return events.groupBy(*(by or []), "query_norm").agg(
        F.count(F.lit(1)).alias("delta"),
        F.min_by("display", first).alias("display"),
        F.min(first).alias("first_seen"),
        F.max("ts").alias("last_ts"),
    )


def merge_folds(*folds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fold of folds; equals folding all events together."""
    both = folds[0]
    for more in folds[1:]:
        both = both.unionByName(more)
    return both.groupBy(*(by or []), "query_norm").agg(
        F.sum("delta").alias("delta"),
        F.min_by("display", "first_seen").alias("display"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_ts").alias("last_ts"),
    )


def requeue(newer: DataFrame, failed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Put failed deltas back: they add up, and a display already waiting is kept."""
    keys = [*(by or []), "query_norm"]
    cols = [*keys, "delta", "display", "last_ts"]
    both = newer.select(*cols, F.lit(1).alias("_newer")).unionByName(failed.select(*cols, F.lit(0).alias("_newer")))
    return both.groupBy(*keys).agg(
        F.sum("delta").alias("delta"),
        F.max_by("display", F.struct("_newer", "last_ts")).alias("display"),
        F.max("last_ts").alias("last_ts"),
    )


def write_reduction(folded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many events became how many written rows, and in how many flushes."""
    flush = by or FLUSH
    # Per flush first: one row per flush is what remains to be counted.
    per_flush = folded.groupBy(*flush).agg(F.sum("delta").alias("e"), F.count(F.lit(1)).alias("r"))
    zero = F.lit(0).cast("bigint")
    totals = per_flush.agg(
        F.coalesce(F.sum("e"), zero).alias("events"),
        F.coalesce(F.sum("r"), zero).alias("rows_written"),
        F.count(F.lit(1)).alias("flushes"),
    )
    ratio = F.try_divide(F.col("events"), F.col("rows_written"))
    percent = F.lit(100.0) * (F.lit(1.0) - F.try_divide(F.col("rows_written"), F.col("events")))
    return totals.select(
        "events", "rows_written", "flushes",
        F.coalesce(scoring.half_up(ratio), F.lit(0.0)).alias("reduction_ratio"),
        F.coalesce(scoring.half_up(percent), F.lit(0.0)).alias("reduction_percent"),
    )
