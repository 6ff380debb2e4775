"""Debounce and superseded requests on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystride.functions import text
from keystride.operators.ordered import next_value
from keystride.params import DEBOUNCE_SECONDS, MAX_GROUP_ROWS
from keystride.session import materialize
from keystride.sources.batches import BatchTable
from keystride.streaming.jobs import _start


def debounce_stream(requests: DataFrame, delay_seconds: float = DEBOUNCE_SECONDS, lateness: str = "1 minute",
                    by: str = "user_id", time: str = "ts", request_id: str = "req_id", value: str = "prefix") -> DataFrame:
    """``replay.debounce`` on a stream: the last request of each session, once the watermark has passed it.

    A session is a run of one user's requests less than the delay apart; of its state only the last
    request is kept, so a user who never rests costs one row. Blank values end a session unseen.
    """
    # A session ends one microsecond early, so that requests exactly the delay apart stay apart.
    gap = f"{round(delay_seconds * 1_000_000) - 1} microseconds"
    last = F.max_by(F.struct(*[F.col(c).alias(c) for c in (request_id, time, value)]), F.struct(time, request_id))
    sessions = requests.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("_session"), by).agg(last.alias("_last"))
    return sessions.select(by, "_last.*").where(~text.is_blank(F.col(value)))


class HeldRequests:
    """Requests whose successor is not settled yet, and those that have been decided."""

    SCHEMA = "req_id bigint, ts timestamp, user_id bigint, took_ms double"

    def __init__(self, spark: SparkSession, root: str):
        self.held = BatchTable(spark, f"{root}/held", self.SCHEMA)
        self.decided = BatchTable(spark, f"{root}/decided", self.SCHEMA + ", superseded boolean")

    def read(self, ended: bool = False) -> DataFrame:
        """Decided requests; once the stream has ended those still held are decided too."""
        rows = self.decided.read().drop("batch_id")
        last = self.held.last()
        if not ended or last is None:
            return rows
        held = self.held.read(after=last - 1, through=last).drop("batch_id")
        return rows.unionByName(_marked(held, MAX_GROUP_ROWS).drop("_next"))

    def vacuum(self) -> None:
        last = self.held.last()
        if last is not None:
            self.held.vacuum(last)


def _marked(rows: DataFrame, max_group_rows: int) -> DataFrame:
    followed = next_value(rows, ["user_id"], [F.asc("ts"), F.asc("req_id")], F.unix_micros("ts"), "_next", max_group_rows)
    done = F.unix_micros("ts") + F.col("took_ms") * F.lit(1000.0)
    return followed.withColumn("superseded", F.coalesce(F.col("_next") < done, F.lit(False)))


def maintain_superseded(requests: DataFrame, store: HeldRequests, checkpoint: str, lateness_seconds: float = 60.0,
                        drain: bool = False, max_group_rows: int = MAX_GROUP_ROWS) -> StreamingQuery:
    """``replay.mark_superseded`` on a stream.

    A request is decided when the next one of its user lies behind the newest request by the lateness, so
    that none can come between them any more. What is held over is a table written with the batch: the
    requests of the last moments and one per user. A later request is decided among those held.
    """
    def advance(batch: DataFrame, batch_id: int) -> None:
        before = store.held.read(after=batch_id - 2, through=batch_id - 1)
        names = [f.name for f in store.held.schema]
        rows = materialize(batch.select(*names).unionByName(before.select(*names)))
        newest = rows.agg(F.max(F.unix_micros("ts"))).first()[0] or 0
        settled = F.col("_next") <= F.lit(newest - round(lateness_seconds * 1_000_000))
        marked = materialize(_marked(rows, max_group_rows))
        store.decided.write(marked.where(settled), batch_id)
        store.held.write(marked.where(~F.coalesce(settled, F.lit(False))), batch_id)

    return _start(requests, advance, checkpoint, drain=drain)
