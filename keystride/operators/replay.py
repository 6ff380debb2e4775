"""Replays of what happens in front of the service: debounce and superseded requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.functions import text
from keystride.operators.ordered import next_value
from keystride.params import DEBOUNCE_SECONDS, MAX_GROUP_ROWS


def _with_next(requests: DataFrame, by: str, time: str, request_id: str, max_group_rows: int) -> DataFrame:
    micros = F.unix_micros(time)
    return next_value(requests, [by], [F.asc(time), F.asc(request_id)], micros, "_next", max_group_rows)


def debounce(requests: DataFrame, delay_seconds: float = DEBOUNCE_SECONDS, by: str = "user_id", time: str = "ts",
             request_id: str = "req_id", value: str = "prefix", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Keep a value if no newer one follows within the delay; a blank value emits nothing.

    A blank value still restarts the wait, so it silences the value before it.
    """
    delay = F.lit(round(delay_seconds * 1_000_000))
    followed = _with_next(requests, by, time, request_id, max_group_rows)
    quiet = F.col("_next").isNull() | (F.col("_next") - F.unix_micros(time) >= delay)
    return followed.where(quiet & ~text.is_blank(F.col(value))).drop("_next")


def mark_superseded(requests: DataFrame, took_ms: str = "took_ms", by: str = "user_id", time: str = "ts",
                    request_id: str = "req_id", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add ``superseded``: the user's next request began before this one was answered."""
    followed = _with_next(requests, by, time, request_id, max_group_rows)
    done = F.unix_micros(time) + F.col(took_ms) * F.lit(1000.0)
    return followed.withColumn("superseded", F.coalesce(F.col("_next") < done, F.lit(False))).drop("_next")
