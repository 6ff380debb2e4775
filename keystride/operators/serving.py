"""Stored suggestion lists: write them, read them while fresh, compute what is missing.

Stored columns: ``cache_key``, ``node``, ``value`` (JSON list), ``expires_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride.functions import text
from keystride.operators import prefix, ring
from keystride.operators.ordered import join_hot
from keystride.session import materialize
from keystride.params import ALPHA, K, TTL_POPULARITY_SECONDS, TTL_RECENCY_SECONDS

_EMPTY_LIST = "[]"


def as_lists(ranked: DataFrame, by: str = "prefix") -> DataFrame:
    """``by, value``: the ranked rows of each group as one JSON list of (query, count)."""
    # A group has at most k rows by now.
    rows = F.sort_array(F.collect_list(F.struct("rank", "query", "count")))
    pairs = F.transform(rows, lambda r: F.struct(r["query"].alias("query"), r["count"].alias("count")))
    return ranked.groupBy(by).agg(text.list_to_json(pairs).alias("value"))


def list_ttl(mode: Column) -> Column:
    seconds = F.when(mode == "RECENCY", TTL_RECENCY_SECONDS).otherwise(TTL_POPULARITY_SECONDS)
    return F.make_dt_interval(secs=seconds)


def materialize_lists(ranked: DataFrame, arcs: DataFrame, as_of: Column, mode: str = "POPULARITY") -> DataFrame:
    """Ranked completions as stored lists, each placed on its ring node."""
    label = F.lit(mode)
    keyed = as_lists(ranked).select(
        text.list_key(F.col("prefix"), label).alias("cache_key"), "value",
        (as_of + list_ttl(label)).alias("expires_at"),
    )
    return ring.assign(keyed, arcs, "cache_key").select("cache_key", "node", "value", "expires_at")


def write_lists(lists: DataFrame, path: str) -> None:
    lists.write.mode("overwrite").partitionBy("node").parquet(path)


def invalidate(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored lists that no changed query can appear in (``changed`` has ``query_norm``)."""
    touched = changed.select(F.explode(text.prefixes(F.col("query_norm"))).alias("prefix")).distinct()
    keys = touched.select(F.explode(F.array(
        text.suggest_key(F.col("prefix")), text.recency_key(F.col("prefix"))
    )).alias("cache_key"))
    return stored.join(keys, "cache_key", "left_anti")


def resolve(requests: DataFrame) -> DataFrame:
    """Requests (``q``, ``mode``) with ``prefix``, resolved ``mode`` and ``cache_key``.

    The key is null for a blank prefix, which no list answers.
    """
    asked = requests.withColumn("prefix", text.normalize(F.col("q"))).withColumn(
        "mode", text.suggest_mode(F.col("mode"))
    )
    key = text.list_key(F.col("prefix"), F.col("mode"))
    return asked.withColumn("cache_key", F.when(F.col("prefix") != "", key))


def compute_lists(missing: DataFrame, dictionary: DataFrame, scores: DataFrame, k: int = K,
                  alpha: float = ALPHA) -> DataFrame:
    """``cache_key, value`` for each (``prefix``, ``mode``, ``cache_key``); an empty list if nothing matches."""
    parts = []
    for mode in ("POPULARITY", "RECENCY"):
        asked = missing.where(F.col("mode") == mode).select("prefix")
        if mode == "POPULARITY":
            ranked = prefix.all_prefix_top(dictionary, k, wanted=asked)
        else:
            ranked = prefix.all_prefix_recency(dictionary, scores, k, alpha, wanted=asked)
        parts.append(as_lists(ranked).withColumn("mode", F.lit(mode)))
    found = parts[0].unionByName(parts[1])
    return missing.join(found, ["prefix", "mode"], "left").select(
        "cache_key", F.coalesce("value", F.lit(_EMPTY_LIST)).alias("value")
    )


def answer(requests: DataFrame, stored: DataFrame, dictionary: DataFrame, scores: DataFrame, as_of: Column,
           k: int = K, alpha: float = ALPHA) -> DataFrame:
    """Every request with its list and where it came from: ``EMPTY``, ``MATERIALIZED``, ``COMPUTED``.

    Missing lists are computed once per distinct key, however many requests ask for it.
    """
    asked = resolve(requests)
    live = stored.where(F.col("expires_at") > as_of).select("cache_key", "value")
    needed = asked.where(F.col("cache_key").isNotNull()).select("prefix", "mode", "cache_key").distinct()
    # Kept once: several branches of the computation read it.
    fresh = materialize(live.join(needed.select("cache_key"), "cache_key", "left_semi"))
    missing = materialize(needed.join(fresh, "cache_key", "left_anti"))
    computed = compute_lists(missing, dictionary, scores, k, alpha)
    lists = fresh.withColumn("source", F.lit("MATERIALIZED")).unionByName(
        computed.withColumn("source", F.lit("COMPUTED"))
    )
    # Very many requests may share a key, or have none.
    return join_hot(asked, materialize(lists), ["cache_key"], "left").withColumn(
        "source", F.coalesce("source", F.lit("EMPTY"))
    ).withColumn("value", F.coalesce("value", F.lit(_EMPTY_LIST)))


def suggest_batch(requests: DataFrame, dictionary: DataFrame, scores: DataFrame, arcs: DataFrame, k: int = K,
                  alpha: float = ALPHA) -> DataFrame:
    """Requests with ``prefix, mode, source, node, value``, nothing stored being read.

    ``source`` is ``DB``, ``DB+RECENCY`` or, for a blank prefix, ``EMPTY``; ``node`` owns the request's key
    and is null for a blank prefix.
    """
    asked = resolve(requests)
    needed = materialize(asked.where(F.col("cache_key").isNotNull()).select("prefix", "mode", "cache_key").distinct())
    lists = compute_lists(needed, dictionary, scores, k, alpha)
    placed = materialize(ring.assign(lists, arcs, "cache_key").select("cache_key", "node", "value"))
    answered = join_hot(asked, placed, ["cache_key"], "left")
    source = F.when(F.col("cache_key").isNull(), "EMPTY").when(F.col("mode") == "RECENCY", "DB+RECENCY").otherwise("DB")
    return answered.withColumn("source", source).withColumn("value", F.coalesce("value", F.lit(_EMPTY_LIST)))


def suggest_one(dictionary: DataFrame, scores: DataFrame, arcs: DataFrame, q: str | None, mode: str | None = None, k: int = K,
                alpha: float = ALPHA) -> DataFrame:
    """``prefix, mode, source, node, value`` of one request; a blank prefix has the source ``EMPTY`` and no node."""
    asked = dictionary.sparkSession.range(1).select(F.lit(q).cast("string").alias("q"), F.lit(mode).cast("string").alias("mode"))
    return suggest_batch(asked, dictionary, scores, arcs, k, alpha).select("prefix", "mode", "source", "node", "value")
