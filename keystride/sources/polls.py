"""The search-event log with positions, read as a stream in polls.

``EventLog`` numbers events as they are appended: an append is a segment of consecutive positions,
written as files sorted by position and named by a commit row, so an append that is repeated after a
failure adds nothing. ``EventPolls`` is a stream source over the positions: a poll holds at most
``max_events`` of them, and waits until ``min_events`` have come or ``max_wait`` seconds have passed,
whichever is first. A micro-batch is one poll, or up to ``max_polls`` of those that a backlog fills, so that
reading up a long log does not cost a batch for each. Positions planned for a batch are in the query's
checkpoint before it runs, so a batch that was cut off is read again with the same bounds.

Layout below the root:
``data/segment=S/attempt=A``  events of one append, with ``position``
``commits``                   a row per append: ``segment, attempt, first, n``
Paths may be any that ``pyarrow.fs`` opens; positions are planned on the driver, rows are read in tasks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from keystride.operators.ordered import row_numbers
from keystride.session import materialize
from keystride.sources.batches import read_or_empty
from keystride.sources.events import EVENT

_COMMIT = "segment bigint, attempt string, first bigint, n bigint"
MAX_EVENTS = 256       # events of a poll
MAX_WAIT_SECONDS = 2.0  # how long a poll waits for more events
ROWS_PER_TASK = 100_000
LOGGED = T.StructType([T.StructField("position", T.LongType()), *EVENT.fields])


class EventLog:
    """The log's writer, and its reader as a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def commits(self) -> DataFrame:
        rows = read_or_empty(self.spark, _COMMIT, f"{self.root}/commits")
        return rows.groupBy("segment").agg(F.min(F.struct("attempt", "first", "n")).alias("c")).select("segment", "c.*")

    def append(self, events: DataFrame, segment: int) -> bool:
        """Add events in the order of time and id; False if this segment has been added before."""
        known = self.commits()
        if not known.where(F.col("segment") == segment).isEmpty():
            return False
        first = known.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0
        events = materialize(events.select(*EVENT.names))  # counted, sampled and written
        attempt = uuid.uuid4().hex
        path = f"{self.root}/data/segment={segment}/attempt={attempt}"
        numbered = row_numbers(events, [], [F.asc("ts"), F.asc("event_id"), F.asc("q"), F.asc("d")], "position")
        placed = numbered.select((F.col("position") - 1 + first).alias("position"), *EVENT.names)
        placed.repartitionByRange("position").sortWithinPartitions("position").write.parquet(path)
        n = self.spark.read.schema(LOGGED).parquet(path).count()
        row = self.spark.range(1).select(F.lit(segment).cast("bigint").alias("segment"), F.lit(attempt).alias("attempt"),
                                         F.lit(first).cast("bigint").alias("first"), F.lit(n).cast("bigint").alias("n"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def read(self) -> DataFrame:
        """``position`` and the events of all committed segments."""
        named = self.commits().collect()  # a row per append
        paths = [f"{self.root}/data/segment={c.segment}/attempt={c.attempt}" for c in named]
        return self.spark.read.schema(LOGGED).parquet(*paths) if paths else read_or_empty(self.spark, LOGGED, f"{self.root}/data")

    def stream(self, max_events: int = MAX_EVENTS, min_events: int = 1, max_wait: float = MAX_WAIT_SECONDS,
               max_polls: int = 1) -> DataFrame:
        """``position, event_id, ts, q, d`` as a stream from the log's start."""
        self.spark.dataSource.register(EventPolls)
        reader = self.spark.readStream.format(EventPolls.name()).option("path", self.root)
        reader = reader.option("maxEvents", max_events).option("minEvents", min_events).option("maxWait", max_wait)
        return reader.option("maxPolls", max_polls).load()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Segment(InputPartition):
    """Positions ``start`` to ``end`` of one committed append."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.most, self.least = int(options.get("maxEvents", MAX_EVENTS)), int(options.get("minEvents", 1))
        self.wait, self.polls = float(options.get("maxWait", MAX_WAIT_SECONDS)), int(options.get("maxPolls", 1))
        self.planned: int | None = None   # end of the last batch that was planned
        self.waiting: tuple[int, float] | None = None  # for events after which position, since when

    def _commits(self) -> list[dict]:
        store, place = _open(f"{self.root}/commits")
        if store.get_file_info(place).type == fs.FileType.NotFound:
            return []
        rows = ds.dataset(place, filesystem=store, format="parquet", exclude_invalid_files=True).to_table().to_pylist()
        one: dict[int, dict] = {}
        for row in sorted(rows, key=lambda r: r["attempt"], reverse=True):
            one[row["segment"]] = row
        return sorted(one.values(), key=lambda r: r["first"])

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        start = self.planned or 0
        there = max((c["first"] + c["n"] for c in self._commits()), default=0) - start
        if there <= 0:
            return {"position": start}
        if there < self.least:
            if self.waiting is None or self.waiting[0] != start:
                self.waiting = (start, time.monotonic())
            if time.monotonic() - self.waiting[1] < self.wait:
                return {"position": start}
        full = min(there // self.most, self.polls)  # a poll that is not full comes alone
        return {"position": start + (full * self.most or there)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        # A restarted query plans its last batch once more, so this is where the polls go on.
        low, high = start["position"], end["position"]
        self.planned = max(high, self.planned or 0)
        parts = []
        for c in self._commits():
            a, b = max(low, c["first"]), min(high, c["first"] + c["n"])
            path = f"{self.root}/data/segment={c['segment']}/attempt={c['attempt']}"
            parts += [Segment(path, i, min(i + ROWS_PER_TASK, b)) for i in range(a, b, ROWS_PER_TASK)]
        return parts

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        store, place = _open(partition.path)
        at = ds.field("position")
        rows = ds.dataset(place, filesystem=store, format="parquet", exclude_invalid_files=True)
        # Files are sorted by position, so statistics leave out those beyond the bounds.
        # Times are instants, kept without a zone by some writers.
        kinds = pa.schema([("position", pa.int64()), ("event_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")),
                           ("q", pa.string()), ("d", pa.string())])
        for batch in rows.to_batches(columns=LOGGED.names, filter=(at >= partition.start) & (at < partition.end)):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kinds, strict=True)], schema=kinds)

    def commit(self, end: dict) -> None:
        self.planned = max(end["position"], self.planned or 0)


class EventPolls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_polls"

    def schema(self) -> T.StructType:
        return LOGGED

    def streamReader(self, schema: T.StructType) -> PollReader:
        return PollReader(self.options)
