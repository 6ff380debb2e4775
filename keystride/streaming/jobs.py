"""Streaming jobs over the search-event log.

Each job writes its micro-batch under the batch's number and commits it with a row of its own. A
batch that runs again after a failure finds its row, or leaves the failed attempt unread, so every
event counts exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystride.operators import expiry, fold, trending
from keystride.operators.merge import deltas_as_rows
from keystride.operators.upkeep import PrefixLists
from keystride.params import FLUSH_INTERVAL_SECONDS, HALF_LIFE_SECONDS
from keystride.session import materialize
from keystride.sources.batches import BatchTable
from keystride.sources.dictionary import DictionaryStore
from keystride.sources.polls import MAX_EVENTS
from keystride.sources.ranges import DictionaryRanges


def _start(stream: DataFrame, per_batch: Callable[[DataFrame, int], None], checkpoint: str,
           mode: str = "append", drain: bool = False,
           every: str = f"{FLUSH_INTERVAL_SECONDS} seconds") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(per_batch)
    trigger = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    return trigger.start()


def maintain_counts(events: DataFrame, store: DictionaryStore, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Fold each micro-batch of raw events and publish it as one delta of the dictionary.

    With ``drain`` the query stops when the log is read up; otherwise it runs until stopped.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        store.commit(deltas_as_rows(fold.fold(fold.usable_events(batch))), batch_id)

    return _start(events, publish, checkpoint, drain=drain)


def maintain_lists(events: DataFrame, dictionary: DictionaryRanges, lists: PrefixLists, checkpoint: str,
                   drain: bool = False) -> StreamingQuery:
    """Fold each micro-batch into the dictionary and bring the lists of its prefixes up to date.

    Both stores remember the last batch they contain, so one that ran half way is completed when it runs
    again.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        deltas = materialize(deltas_as_rows(fold.fold(fold.usable_events(batch))))
        dictionary.upsert(deltas, batch_id)
        lists.update(dictionary, deltas, batch_id)

    return _start(events, publish, checkpoint, drain=drain)


class FlushStore:
    """Folds of flushes as polls bring them; a flush that spans several polls is merged when read."""

    SCHEMA = ("flush bigint, query_norm string, delta bigint, display string, "
              "first_seen struct<ts: timestamp, event_id: bigint>, last_ts timestamp")

    def __init__(self, spark: SparkSession, root: str):
        self.batches = BatchTable(spark, root, self.SCHEMA)

    def read(self) -> DataFrame:
        return fold.merge_folds(self.batches.read(), by=["flush"])


def maintain_flushes(events: DataFrame, store: FlushStore, checkpoint: str, flush_events: int = 2 * MAX_EVENTS,
                     drain: bool = False) -> StreamingQuery:
    """Fold a log that is read in polls into flushes of ``flush_events`` consecutive positions.

    A flush closes with the poll that brings it to the flush threshold of 500: two full polls of 256. With
    ``drain`` the log is read up and the query stopped.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        numbered = fold.usable_events(batch).withColumn("flush", F.floor(F.col("position") / flush_events))
        store.batches.write(fold.fold(numbered, ["flush"]), batch_id)

    query = _start(events, publish, checkpoint, every="0 seconds" if drain else f"{FLUSH_INTERVAL_SECONDS} seconds")
    if drain:  # polls have bounds of their own, so the log is not one batch
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query


class PartialStore:
    """Per-window score sums as a stream writes them; a window's latest batch counts."""

    SCHEMA = "query_norm string, window_end timestamp, partial double"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.batches = BatchTable(spark, f"{self.root}/batches", self.SCHEMA)
        # Its batch N holds all partials through batch N of the stream.
        self.gathered = BatchTable(spark, f"{self.root}/gathered", self.SCHEMA)

    def write(self, partials: DataFrame, batch_id: int) -> None:
        self.batches.write(partials, batch_id)

    def read(self) -> DataFrame:
        through = self.gathered.last()
        rows = self.batches.read(after=through)
        if through is not None:
            rows = rows.unionByName(self.gathered.read(after=through - 1, through=through))
        return rows.groupBy("query_norm", "window_end").agg(F.max_by("partial", "batch_id").alias("partial"))

    def compact(self) -> None:
        """Gather the partials of all batches so far, so that readers list few folders."""
        last = self.batches.last()
        if last is not None and last != self.gathered.last():
            through = self.gathered.last()
            rows = self.batches.read(after=through, through=last)
            if through is not None:
                rows = rows.unionByName(self.gathered.read(after=through - 1, through=through))
            self.gathered.write(rows.groupBy("query_norm", "window_end").agg(F.max_by("partial", "batch_id").alias("partial")), last)

    def vacuum(self) -> None:
        """Remove batches that are gathered, and gatherings before the last."""
        through = self.gathered.last()
        if through is not None:
            self.batches.vacuum(through + 1)
            self.gathered.vacuum(through)


def maintain_scores(events: DataFrame, store: PartialStore, checkpoint: str, width: str = "1 hour",
                    lateness: str = "10 minutes", half_life: float = HALF_LIFE_SECONDS,
                    drain: bool = False) -> StreamingQuery:
    """Keep per-window partial scores; state is dropped once the watermark passes a window.

    Old scores are never rewritten: a total at any time is a weighted sum of the partials. Events
    later than the watermark allows are left out here (they still count in the dictionary).
    """
    on_time = fold.usable_events(events).withWatermark("ts", lateness)
    partials = trending.score_partials(on_time, width, half_life)
    return _start(partials, store.write, checkpoint, mode="update", drain=drain)


class EntryStore:
    """Refilled entries per batch, and the entries alive after each batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _table(self, name: str, schema: str) -> BatchTable:
        return BatchTable(self.spark, f"{self.root}/{name}", schema)

    def alive_before(self, batch_id: int, schema: str) -> DataFrame:
        return self._table("alive", schema).read(after=batch_id - 2, through=batch_id - 1).drop("batch_id")

    def write(self, filled: DataFrame, alive: Callable[[DataFrame], DataFrame], batch_id: int) -> None:
        table = self._table("filled", ", ".join(f"`{n}` {t}" for n, t in filled.dtypes))
        table.write(filled, batch_id)
        written = table.read(after=batch_id - 1, through=batch_id).drop("batch_id")
        after = alive(written)
        self._table("alive", ", ".join(f"`{n}` {t}" for n, t in after.dtypes)).write(after, batch_id)

    def filled(self, schema: str) -> DataFrame:
        return self._table("filled", schema).read().drop("batch_id")


def track_entries(requests: DataFrame, store: EntryStore, checkpoint: str, key: str, ttl_ms: int,
                  drain: bool = False, lateness_ms: int | None = None) -> StreamingQuery:
    """Which requests refill their key's entry, on a stream.

    What a micro-batch needs from the past is one end time per live key. It is a table written with
    the batch rather than operator state, so a hot key's requests are still folded and sliced over
    many tasks. A batch reads what its predecessor left, which makes a repeated batch harmless.

    With ``lateness_ms`` entries that ended so long before the newest refill are forgotten, so the table
    holds live keys only; requests later than that are taken for new ones.
    """
    kind = dict(requests.dtypes)[key]

    def advance(batch: DataFrame, batch_id: int) -> None:
        before = store.alive_before(batch_id, f"{key} {kind}, ends_ms bigint")
        filled = expiry.refills(batch, key, ttl_ms, entries=before)

        def alive(written: DataFrame) -> DataFrame:
            both = expiry.open_entries(written, key, ttl_ms).unionByName(before)
            if lateness_ms is not None:
                newest = both.agg(F.max("ends_ms")).first()[0]
                if newest is not None:
                    both = both.where(F.col("ends_ms") > newest - ttl_ms - lateness_ms)
            return both.groupBy(key).agg(F.max("ends_ms").alias("ends_ms"))

        store.write(filled, alive, batch_id)

    return _start(requests, advance, checkpoint, drain=drain)
