"""Fixed time-to-live: which requests refill an entry, which are served from it.

An entry filled at ``t`` serves requests before ``t + ttl``; a hit does not extend it, and the
first request at or after the end refills it. Refills form a chain, so each depends on all before
it. Requests of one key in one millisecond are folded first, as only the first can refill. Short keys
are then folded by a built-in aggregation over their sorted times, longer ones that fit a task are
replayed whole by array functions. Beyond that the time line is cut into slices:

1. Each slice answers on its own: if the entry I inherit ends at x, when does the one I leave end?
   The answer is a step function of at most ``ttl`` milliseconds' steps.
2. The functions of neighbouring slices are composed, a bounded number at a time, level by level;
   going back down, every slice learns what it inherits.
3. The slices are replayed independently.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride.operators.ordered import largest_group, null_safe_join
from keystride.session import materialize

# Entries of one key that one task holds at a time.
TASK_ENTRIES = 1_000_000
# Entries of one key that are folded without a Python worker; the fold copies the refills it has found.
FOLDED_ENTRIES = 4_000
LIFETIMES = COMPOSED = 32  # lifetimes per slice, functions composed at a time; fewer if they are large

_STEPS = "upto array<bigint>, leaves array<bigint>"
_NEVER = -(2 ** 62)


def _trimmer():
    """Made inside a function, as all that workers run here is, so that it travels with the job."""
    def trim(upto, leaves, end):
        """Keep the steps an entry ending before ``end`` can meet, equal neighbours joined."""
        keep = int(np.searchsorted(upto, end)) + 1
        upto, leaves = upto[:keep], leaves[:keep]
        last_of_run = np.append(leaves[1:] != leaves[:-1], True)
        return upto[last_of_run], leaves[last_of_run]

    return trim


def _summarize(ttl: int, slice_ms: int):
    """Step function of a slice from its sorted request times."""
    trim = _trimmer()

    def steps(times, number):
        times = np.asarray(times, dtype="int64")
        following = np.searchsorted(times, times + ttl)
        # Jump to the last refill of the chain that begins at each request.
        at = np.where(following < len(times), following, np.arange(len(times)))
        while True:
            further = at[at]
            if (further == at).all():
                break
            at = further
        return trim(times, times[at] + ttl, number * slice_ms + ttl)

    def summarize(times: pd.Series, number: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([steps(t, n) for t, n in zip(times, number)], columns=["upto", "leaves"])

    return F.pandas_udf(summarize, _STEPS)


def _compose(ttl: int, span_ms: int):
    """One step function for a run of slices; ``span_ms`` is the length of the run."""
    trim = _trimmer()

    def one(parts, number):
        upto = leaves = None
        for part in parts:
            u, v = np.asarray(part["upto"], dtype="int64"), np.asarray(part["leaves"], dtype="int64")
            if upto is None:
                upto, leaves = u, v
                continue
            hit = np.searchsorted(u, leaves)
            through = np.where(hit < len(u), v[np.minimum(hit, len(u) - 1)], leaves)
            later = u > upto[-1]
            upto, leaves = np.append(upto, u[later]), np.append(through, v[later])
        return trim(upto, leaves, number * span_ms + ttl)

    def compose(parts: pd.Series, number: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, n) for p, n in zip(parts, number)], columns=["upto", "leaves"])

    return F.pandas_udf(compose, _STEPS)


def _hand_down():
    """What each slice of a run inherits, given what the run inherits."""
    def each(parts, end):
        end = None if pd.isna(end) else int(end)
        rows = []
        for part in parts:
            rows.append({"number": part["number"], "inherits": end})
            at = 0 if end is None else int(np.searchsorted(np.asarray(part["upto"]), end))
            if at < len(part["leaves"]):
                end = int(part["leaves"][at])
        return rows

    def hand_down(parts: pd.Series, inherits: pd.Series) -> pd.Series:
        return pd.Series([each(p, x) for p, x in zip(parts, inherits)], dtype=object)

    return F.pandas_udf(hand_down, "array<struct<number:bigint,inherits:bigint>>")


def _replay(ttl: int):
    """Indices of the refilling requests of a slice."""
    def walk(times, end):
        at = 0 if pd.isna(end) else int(np.searchsorted(times, end))
        found = []
        while at < len(times):
            found.append(at)
            at = int(np.searchsorted(times, times[at] + ttl))
        return found

    def replay(times: pd.Series, inherits: pd.Series) -> pd.Series:
        return pd.Series([walk(np.asarray(t), x) for t, x in zip(times, inherits)], dtype=object)

    return F.pandas_udf(replay, "array<int>")


def _inherited(functions: DataFrame, key: str, ttl: int, span_ms: int, fan: int) -> DataFrame:
    """``key, number, inherits`` for step functions numbered along time."""
    parent = F.floor(F.col("number") / F.lit(fan))
    runs = functions.groupBy(key, parent.alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("number", "upto", "leaves"))).alias("parts")  # fan entries at most
    )
    if functions.groupBy(key).agg((F.min(parent) != F.max(parent)).alias("m")).where("m").isEmpty():
        given = runs.withColumn("inherits", F.lit(None).cast("bigint"))
    else:
        span = span_ms * fan
        above = runs.select(key, F.col("parent").alias("number"), _compose(ttl, span)("parts", "parent").alias("f"))
        above = materialize(above.select(key, "number", "f.*"))
        handed = _inherited(above, key, ttl, span, fan).withColumnRenamed("number", "parent")
        given = null_safe_join(runs, handed, [key, "parent"])
    return given.select(key, F.explode(_hand_down()("parts", "inherits")).alias("e")).select(key, "e.*")


def refills(requests: DataFrame, key: str, ttl_ms: int, time: str = "ts", request_id: str = "req_id",
            entries: DataFrame | None = None, task_entries: int = TASK_ENTRIES,
            folded_entries: int = FOLDED_ENTRIES) -> DataFrame:
    """``key, filled_ms, request_id``: the requests that refill their key's entry.

    ``entries`` (``key``, ``ends_ms``) are entries still alive from earlier data; requests before
    their end are served from them.
    """
    ms = F.floor(F.unix_micros(time) / F.lit(1000))
    once = (
        requests.select(F.col(key), ms.alias("ms"), F.col(request_id).alias("id"))
        .groupBy(key, "ms").agg(F.min("id").alias("id"))
    )
    if entries is not None:
        served = F.col("ms") < F.coalesce("ends_ms", F.lit(_NEVER))
        once = null_safe_join(once, entries.select(key, "ends_ms"), [key], "left").where(~served).drop("ends_ms")
    largest = largest_group(once, [key])
    if largest <= min(folded_entries, task_entries):
        return _folded(once, key, ttl_ms, request_id)
    if largest <= task_entries:
        sliced = _pack(once.withColumn("number", F.lit(0)), key).withColumn("inherits", F.lit(None).cast("bigint"))
    else:
        sliced = _sliced(once, key, ttl_ms, task_entries)
    filled = sliced.select(key, "times", "ids", _replay(ttl_ms)("times", "inherits").alias("at"))
    return filled.select(key, F.explode(F.transform("at", lambda i: F.struct(
        F.get("times", i).alias("filled_ms"), F.get("ids", i).alias(request_id)
    ))).alias("f")).select(key, "f.*")


def _folded(once: DataFrame, key: str, ttl_ms: int, request_id: str) -> DataFrame:
    """Refills of each key by one pass over its sorted times."""
    kind = once.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<filled_ms:bigint,id:{kind}>>")
    start = F.struct(F.lit(_NEVER).cast("bigint").alias("ends"), none.alias("filled"))

    def step(state: Column, x: Column) -> Column:
        refill = F.struct(x["ms"].alias("filled_ms"), x["id"].alias("id"))
        after = F.struct((x["ms"] + F.lit(ttl_ms)).alias("ends"), F.array_append(state["filled"], refill).alias("filled"))
        return F.when(x["ms"] >= state["ends"], after).otherwise(state)

    sorted_times = F.sort_array(F.collect_list(F.struct(F.col("ms").cast("bigint").alias("ms"), "id")))
    folded = once.groupBy(key).agg(sorted_times.alias("p")).select(
        key, F.explode(F.aggregate("p", start, step)["filled"]).alias("f"))
    return folded.select(key, "f.filled_ms", F.col("f.id").alias(request_id))


def _pack(once: DataFrame, key: str) -> DataFrame:
    """Times and ids of each (key, number) as two arrays in time order."""
    packed = once.groupBy(key, "number").agg(F.sort_array(F.collect_list(F.struct("ms", "id"))).alias("p"))
    return packed.select(key, "number", F.col("p.ms").alias("times"), F.col("p.id").alias("ids"))


def _sliced(once: DataFrame, key: str, ttl_ms: int, task_entries: int) -> DataFrame:
    """Slices of all keys with what each inherits."""
    def numbered(lifetimes: int) -> DataFrame:
        return once.withColumn("number", F.floor(F.col("ms") / F.lit(ttl_ms * lifetimes)))

    fullest = largest_group(numbered(LIFETIMES), [key, "number"])
    lifetimes = min(LIFETIMES, max(1, LIFETIMES * task_entries // max(fullest, 1)))
    sliced = materialize(_pack(numbered(lifetimes), key))
    slice_ms = ttl_ms * lifetimes
    functions = sliced.select(key, "number", _summarize(ttl_ms, slice_ms)("times", "number").alias("f"))
    functions = materialize(functions.select(key, "number", "f.*"))
    steps = functions.agg(F.max(F.size("upto"))).first()[0] or 1
    fan = min(COMPOSED, max(2, task_entries // steps))
    return null_safe_join(sliced, _inherited(functions, key, ttl_ms, slice_ms, fan), [key, "number"])


def label_hits(requests: DataFrame, key: str, ttl_ms: int, time: str = "ts",
               request_id: str = "req_id") -> DataFrame:
    """Add ``source``: ``COMPUTED`` for a refill, ``CACHE`` for a request served from the entry."""
    filled = refills(requests, key, ttl_ms, time, request_id).select(request_id, F.lit("COMPUTED").alias("source"))
    return requests.join(filled, request_id, "left").withColumn("source", F.coalesce("source", F.lit("CACHE")))


def open_entries(filled: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """``key, ends_ms``: the entry each key is left with."""
    return filled.groupBy(key).agg((F.max("filled_ms") + F.lit(ttl_ms)).alias("ends_ms"))
