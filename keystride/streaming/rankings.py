"""Scores that lose no late event, and trending lists kept up from a stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystride.functions import scoring
from keystride.operators import fold, trending
from keystride.params import ALPHA, HALF_LIFE_SECONDS, TRENDING_SIZE, TTL_TRENDING_SECONDS
from keystride.session import materialize
from keystride.sources.batches import BatchTable
from keystride.streaming.jobs import _start

_PARTIAL = "query_norm string, window_end timestamp, partial double"


class WindowSums:
    """Per-window score sums. Partial sums add up, so each batch writes its own and no state is kept.

    ``late`` holds the events that came behind the watermark, ``backfills`` the sums made of them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.sums = BatchTable(spark, f"{root}/sums", _PARTIAL)
        self.late = BatchTable(spark, f"{root}/late", "event_id bigint, ts timestamp, query_norm string, window_end timestamp")
        self.backfills = BatchTable(spark, f"{root}/backfills", _PARTIAL)
        self.marks = BatchTable(spark, f"{root}/marks", "newest timestamp")
        # Its batch N holds all sums through batch N.
        self.gathered = BatchTable(spark, f"{root}/gathered", _PARTIAL)

    def newest(self, before: int | None = None) -> int | None:
        """Microseconds of the newest event of the batches before one."""
        through = None if before is None else before - 1
        return self.marks.read(through=through).agg(F.max(F.unix_micros("newest"))).first()[0]

    def read(self) -> DataFrame:
        """``query_norm, window_end, partial``, late events included once they are filled in."""
        through = self.gathered.last()
        rows = self.sums.read(after=through)
        if through is not None:
            rows = rows.unionByName(self.gathered.read(after=through - 1, through=through))
        both = rows.unionByName(self.backfills.read())
        return both.groupBy("query_norm", "window_end").agg(F.sum("partial").alias("partial"))

    def backfill(self, width: str = "1 hour", half_life: float = HALF_LIFE_SECONDS) -> bool:
        """Reopen the windows of late events and add them; each is added once."""
        last, done = self.late.last(), self.backfills.last()
        if last is None or last == done:
            return False
        rows = self.late.read(after=done, through=last)
        return self.backfills.write(trending.score_partials(rows, width, half_life), last)

    def compact(self) -> None:
        """Gather the sums of all batches so far, so that readers list few folders."""
        last, through = self.sums.last(), self.gathered.last()
        if last is None or last == through:
            return
        rows = self.sums.read(after=through, through=last)
        if through is not None:
            rows = rows.unionByName(self.gathered.read(after=through - 1, through=through))
        self.gathered.write(rows.groupBy("query_norm", "window_end").agg(F.sum("partial").alias("partial")), last)
        self.sums.vacuum(last + 1)
        if through is not None:
            self.gathered.vacuum(last)


def maintain_sums(events: DataFrame, store: WindowSums, checkpoint: str, width: str = "1 hour", lateness_seconds: float = 600.0,
                  half_life: float = HALF_LIFE_SECONDS, drain: bool = False) -> StreamingQuery:
    """Add each micro-batch's events to their windows; events behind the watermark go to ``store.late``.

    The watermark of a batch is the newest event of the batches before it less the lateness; an event is
    late when its window has ended by then. A batch that runs again finds the same watermark.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        windowed = fold.usable_events(batch).withColumn("window_end", F.window("ts", width)["end"])
        rows = materialize(windowed.select("event_id", "ts", "query_norm", "window_end"))
        newest = store.newest(before=batch_id)
        mark = None if newest is None else newest - round(lateness_seconds * 1_000_000)
        late = F.lit(False) if mark is None else F.unix_micros("window_end") <= F.lit(mark)
        store.late.write(rows.where(late), batch_id)
        store.sums.write(trending.score_partials(rows.where(~late), width, half_life), batch_id)
        store.marks.write(rows.agg(F.max("ts").alias("newest")).where("newest is not null"), batch_id)

    return _start(events, publish, checkpoint, drain=drain)


class SnapshotStore:
    """Trending lists by time, and the window sums they are made of."""

    SCHEMA = "as_of timestamp, rank int, query string, count bigint, score double, blended double, source string"

    def __init__(self, spark: SparkSession, root: str):
        self.sums = BatchTable(spark, f"{root}/sums", _PARTIAL)
        self.lists = BatchTable(spark, f"{root}/lists", self.SCHEMA)

    def read(self) -> DataFrame:
        """The newest list of each time: a late event replaces the lists after it."""
        rows = self.lists.read()
        newest = rows.groupBy("as_of").agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, ["as_of", "batch_id"]).drop("batch_id")


def write_snapshots(store: SnapshotStore, dictionary: DataFrame, batch_id: int, first_us: int, last_us: int, every_seconds: int,
                    size: int, alpha: float, half_life: float) -> None:
    """Lists from one time to another, from all sums written so far."""
    step = every_seconds * 1_000_000
    sums = store.sums.read(through=batch_id).groupBy("query_norm", "window_end").agg(F.sum("partial").alias("partial"))
    # What lies before is one decayed row per query.
    before = F.timestamp_micros(F.lit(first_us - step))
    at = F.unix_micros("window_end")
    old = trending.scores_from_partials(sums.where(at <= first_us - step), before, half_life).where("score > 0")
    partials = sums.where(at > first_us - step).unionByName(
        old.select("query_norm", before.alias("window_end"), F.col("score").alias("partial")))
    moments = [dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc).replace(tzinfo=None).isoformat(" ") for us in (first_us, last_us)]
    lists = trending.trending_snapshots(materialize(partials), dictionary, *moments, every_seconds, size, alpha, half_life)
    store.lists.write(lists.drop("snapshot"), batch_id)


def maintain_snapshots(events: DataFrame, dictionary: DataFrame, store: SnapshotStore, checkpoint: str, first: str,
                       every_seconds: int = TTL_TRENDING_SECONDS, size: int = TRENDING_SIZE, alpha: float = ALPHA,
                       half_life: float = HALF_LIFE_SECONDS, drain: bool = False, last: str | None = None) -> StreamingQuery:
    """A trending list for every ``every_seconds`` of event time from ``first`` on.

    Each micro-batch writes the lists since the one before it, and again those that its late events
    change. With ``drain`` lists are written up to ``last`` when the log is read up.
    """
    step, start = every_seconds * 1_000_000, scoring.micros_of(first)

    def write(batch_id: int, low: int | None, high: int) -> None:
        done = store.lists.read(through=batch_id - 1).agg(F.max(F.unix_micros("as_of"))).first()[0]
        fresh = start if done is None else done + step
        begin = fresh if low is None else max(start, min(fresh, low))
        if begin <= high:
            write_snapshots(store, dictionary, batch_id, begin, high, every_seconds, size, alpha, half_life)

    def publish(batch: DataFrame, batch_id: int) -> None:
        partials = materialize(trending.score_partials(fold.usable_events(batch), f"{every_seconds} seconds", half_life))
        store.sums.write(partials, batch_id)
        low, high = partials.agg(F.min(F.unix_micros("window_end")), F.max(F.unix_micros("window_end"))).first()
        if low is not None:
            # The first list that sees the earliest of the windows.
            write(batch_id, start + -(-(low - start) // step) * step, start + (high - start) // step * step)

    query = _start(events, publish, checkpoint, drain=drain)
    if drain:
        query.awaitTermination()
        written = store.sums.last()
        if last is not None:
            write(-1 if written is None else written + 1, None, scoring.micros_of(last))
    return query
