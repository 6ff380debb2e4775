"""Entry expiry on a stream with Spark's keyed state: one value and one timer per live key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def refills_in_state(requests: DataFrame, key: str, ttl_ms: int, lateness: str = "1 minute", time: str = "ts",
                     request_id: str = "req_id") -> DataFrame:
    """The key, ``filled_ms, req_id`` of every request that refills its key's entry, as a stream.

    State holds when a key's entry ends. A timer drops it once the watermark has passed that end, so
    the state is bounded by the live keys whatever keys have ever been asked for. Of requests in one
    millisecond the one with the smallest id counts. A key's requests of one micro-batch are two numbers
    each in one task; ``jobs.track_entries`` slices them instead, for keys too hot for that.
    """
    kind = dict(requests.dtypes)[key]

    def advance(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [(p["ms"].to_numpy(), p["id"].to_numpy()) for p in parts]
        times, ids = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        (ends,) = state.get if state.exists else (int(times[0]),)
        filled = []
        at = int(np.searchsorted(times, ends))
        while at < len(times):
            filled.append(at)
            ends = int(times[at]) + ttl_ms
            at = int(np.searchsorted(times, ends))
        state.update((ends,))
        # A timer must lie ahead of the watermark; an entry that has ended by then goes with the next batch.
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        if filled:
            yield pd.DataFrame({key: pd.Series([keys[0]] * len(filled), dtype=object if kind == "string" else None),
                                "filled_ms": times[filled], "req_id": ids[filled]})

    slim = requests.withWatermark(time, lateness).select(
        key, time, F.floor(F.unix_micros(time) / F.lit(1000)).cast("bigint").alias("ms"), F.col(request_id).cast("bigint").alias("id"))
    return slim.groupBy(key).applyInPandasWithState(
        advance, f"`{key}` {kind}, filled_ms bigint, req_id bigint", "ends_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)
