"""Best completions of a prefix, or of every prefix at once.

Dictionary columns: ``query``, ``query_norm``, ``count``. Ties go to the smaller query text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.functions import scoring, text
from keystride.operators.ordered import join_hot
from keystride.params import (
    ALPHA, K, MAX_BROADCAST_ROWS, MAX_GROUP_ROWS, candidate_pool,
)
from keystride.session import materialize


def _ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows overall with their rank; only those rows meet in one task."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _by_count(query: str = "query") -> list[Column]:
    return [F.desc("count"), F.asc(query)]


def starting_with(dictionary: DataFrame, prefix: str) -> DataFrame:
    """Rows whose normal form starts with the literal prefix; reaches a Parquet scan as a filter."""
    # Constants, so the optimizer works them out before the filter is pushed down.
    wanted = text.normalize(F.lit(prefix).cast("string"))
    return dictionary.where((wanted != "") & F.startswith(F.col("query_norm"), wanted))


def prefix_top(dictionary: DataFrame, prefix: str, k: int = K) -> DataFrame:
    """``rank, query, count`` of the most searched completions of one prefix."""
    found = starting_with(dictionary, prefix).select("query", "count")
    return _ranked(found, _by_count(), k).select("rank", "query", "count")


def global_top(dictionary: DataFrame, k: int = K) -> DataFrame:
    """``rank, query, count`` of the most searched queries."""
    return _ranked(dictionary.select("query", "count"), _by_count(), k).select("rank", "query", "count")


def per_norm(dictionary: DataFrame, how: str = "max") -> DataFrame:
    """One row per normal form; ``how`` is ``max`` (best variant's count) or ``sum``."""
    if how not in ("max", "sum"):
        raise ValueError(f"how must be 'max' or 'sum', not {how!r}")
    total = F.max("count") if how == "max" else F.sum("count")
    return dictionary.groupBy("query_norm").agg(total.alias("count"))


def norm_top(dictionary: DataFrame, prefix: str, k: int = K, how: str = "max") -> DataFrame:
    """As ``prefix_top``, on normal forms: spelling variants count as one completion."""
    found = per_norm(starting_with(dictionary, prefix), how)
    found = found.select(F.col("query_norm").alias("query"), "count")
    return _ranked(found, _by_count(), k).select("rank", "query", "count")


def explode_prefixes(dictionary: DataFrame, max_length: int | None = None, lengths: list[int] | None = None) -> DataFrame:
    """One row per query and prefix of its normal form, of all lengths or of those given."""
    norm = F.col("query_norm")
    if lengths is not None:
        fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length(norm))
        return dictionary.withColumn("prefix", F.explode(F.transform(fitting, lambda n: F.substring(norm, F.lit(1), n))))
    return dictionary.withColumn("prefix", F.explode(text.prefixes(norm, max_length)))


def only_for(wanted: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS):
    """How to answer just the prefixes in ``wanted`` (one column, ``prefix``).

    Returns the lengths to spread, a cut for the spread rows and a cut for the ranked ones.
    A short list is broadcast and drops rows before they are ranked. A long one is applied after
    the ranking, when a prefix has at most ``k`` rows left, so a hot prefix never meets a join.
    """
    # A number for each length that occurs.
    found = wanted.groupBy(F.char_length("prefix").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()
    lengths = sorted(r.n for r in found if r.n)
    if sum(r.c for r in found) <= max_broadcast:
        return lengths, lambda spread: spread.join(F.broadcast(wanted), "prefix", "left_semi"), lambda top: top
    return lengths, lambda spread: spread, lambda top: top.join(wanted, "prefix", "left_semi")


def allow_group_limit(df: DataFrame, k: int) -> None:
    """Let Spark cut groups to ``k`` rows before the shuffle, which it does up to a set number only."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")) < k:
        conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(k))


def sort_for_prefixes(dictionary: DataFrame) -> DataFrame:
    """Lay the dictionary out by normal form, as a stored dictionary is.

    Queries that share prefixes then sit in the same input split, so the per-task group limit of
    the all-prefix jobs leaves little more than the final rows to shuffle, and a hot prefix is
    spread over many splits of equal size.
    """
    return dictionary.repartitionByRange("query_norm", "query")


def all_prefix_top(dictionary: DataFrame, k: int = K, max_length: int | None = None,
                   wanted: DataFrame | None = None, cluster: bool = False) -> DataFrame:
    """``prefix, rank, query, count``: the top ``k`` of every prefix, or of the ``wanted`` ones.

    The rank filter becomes a group limit before the shuffle: each task forwards at most ``k`` rows
    per prefix, so a prefix that matches a third of the dictionary stays cheap. Set ``cluster`` for
    a dictionary that is not stored by normal form; see ``sort_for_prefixes``.
    """
    cut = keep = lengths = None
    if wanted is not None:
        lengths, cut, keep = only_for(wanted)
    allow_group_limit(dictionary, k)
    rows = dictionary.select("query", "query_norm", "count")
    spread = explode_prefixes(sort_for_prefixes(rows) if cluster else rows, max_length, lengths)
    ranked = (cut(spread) if cut else spread).withColumn(
        "rank", F.row_number().over(Window.partitionBy("prefix").orderBy(*_by_count()))
    ).where(F.col("rank") <= k)
    return (keep(ranked) if keep else ranked).select("prefix", "rank", "query", "count")


def all_prefix_norm_top(dictionary: DataFrame, k: int = K, max_length: int | None = None,
                        how: str = "max", cluster: bool = False) -> DataFrame:
    """As ``all_prefix_top``, on normal forms."""
    merged = per_norm(dictionary, how).withColumn("query", F.col("query_norm"))
    return all_prefix_top(merged, k, max_length, cluster=cluster)


def with_scores(dictionary: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach the recency score of each row's normal form, 0 where there is none, and its level, else null."""
    level = F.col("level") if "level" in scores.columns else F.when(F.col("score") > 0, F.log2("score"))
    known = scores.select("query_norm", "score", scoring.settled_level(level).alias("level"))
    return dictionary.join(known, "query_norm", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _blend_order() -> list[Column]:
    return [F.desc("blended"), F.desc("count"), F.asc("query")]


def prefix_recency(dictionary: DataFrame, scores: DataFrame, prefix: str, k: int = K,
                   alpha: float = ALPHA, pool: int | None = -1) -> DataFrame:
    """``rank, query, count, score, blended`` of one prefix, recency blended in.

    Only the ``pool`` most searched completions take part (default ``max(5k, 50)``);
    ``pool=None`` lets every completion compete.
    """
    pool = candidate_pool(k) if pool == -1 else pool
    found = starting_with(dictionary, prefix).select("query", "query_norm", "count")
    if pool is None:
        scored = materialize(with_scores(found, scores))  # read for both maxima and for the rows
        tops = scored.agg(F.max("count").alias("c"), F.max("level").alias("s"))
        top_count, top_score = tops.select("c").scalar(), tops.select("s").scalar()
    else:
        found = found.orderBy(*_by_count()).limit(pool)
        # ``pool`` rows: they filter the score table where it lies instead of shuffling it.
        wanted = scores.join(F.broadcast(found.select("query_norm")), "query_norm", "left_semi")
        scored = with_scores(found, wanted)
        everyone = Window.partitionBy()
        top_count, top_score = F.max("count").over(everyone), F.max("level").over(everyone)
    share = scoring.share_of(F.col("level"), top_score)
    blended = scoring.settled(scoring.blend(F.col("count"), top_count, share, F.lit(1.0), alpha))
    return _ranked(scored.withColumn("blended", blended), _blend_order(), k).select(
        "rank", "query", "count", "score", "blended"
    )


def _with_tops(spread: DataFrame, max_group_rows: int) -> DataFrame:
    """Add each prefix's highest count and score, all its rows considered.

    A short prefix may match a third of the rows. Such prefixes are few (each holds more than
    ``max_group_rows`` rows), so their maxima are broadcast and their rows stay where they are;
    only the rows of the others are shuffled to their maxima.
    """
    tops = materialize(spread.groupBy("prefix").agg(
        F.max("count").alias("top_count"), F.max("level").alias("top_level"), F.count(F.lit(1)).alias("_size")
    ))
    hot = tops.where(F.col("_size") > max_group_rows)
    tops, large = tops.drop("_size"), hot.drop("_size")
    hot_rows = hot.count()
    if not hot_rows:
        return spread.join(tops, "prefix")
    if hot_rows > MAX_BROADCAST_ROWS:
        return join_hot(spread, tops, ["prefix"])
    few = F.broadcast(large)
    rest = spread.join(F.broadcast(large.select("prefix")), "prefix", "left_anti").join(tops, "prefix")
    return rest.unionByName(spread.join(few, "prefix").select(*rest.columns))


def all_prefix_recency(dictionary: DataFrame, scores: DataFrame, k: int = K, alpha: float = ALPHA,
                       pool: int | None = -1, max_length: int | None = None,
                       wanted: DataFrame | None = None, cluster: bool = False,
                       max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``prefix, rank, query, count, score, blended`` for every prefix, or the ``wanted`` ones.

    Scores are joined before the prefixes are spread out, once per query instead of once per
    (query, prefix). Pool cut, maxima and final rank share the one shuffle by prefix. ``cluster``
    lays the joined rows out by normal form first, for a dictionary that is not stored that way or
    a score table too large to broadcast.
    """
    pool = candidate_pool(k) if pool == -1 else pool
    cut = keep = lengths = None
    if wanted is not None:
        lengths, cut, keep = only_for(wanted)
    allow_group_limit(dictionary, max(k, pool or 0))
    scored = with_scores(dictionary.select("query", "query_norm", "count"), scores)
    spread = explode_prefixes(sort_for_prefixes(scored) if cluster else scored, max_length, lengths)
    spread = cut(spread) if cut else spread
    by_prefix = Window.partitionBy("prefix")
    if pool is None:
        pooled = _with_tops(spread, max_group_rows)
    else:
        pooled = (
            spread.withColumn("_n", F.row_number().over(by_prefix.orderBy(*_by_count())))
            .where(F.col("_n") <= pool)
            .withColumn("top_count", F.max("count").over(by_prefix))
            .withColumn("top_level", F.max("level").over(by_prefix))
        )
    share = scoring.share_of(F.col("level"), F.col("top_level"))
    blended = scoring.blend(F.col("count"), F.col("top_count"), share, F.lit(1.0), alpha)
    ranked = pooled.withColumn("blended", scoring.settled(blended)).withColumn(
        "rank", F.row_number().over(by_prefix.orderBy(*_blend_order()))
    ).where(F.col("rank") <= k)
    return (keep(ranked) if keep else ranked).select("prefix", "rank", "query", "count", "score", "blended")


def suggest(dictionary: DataFrame, scores: DataFrame, prefix: str | None, mode: str = "popularity", k: int = K,
            alpha: float = ALPHA, source: str = "DB") -> DataFrame:
    """``prefix, mode, source, rank, query, count`` for one request; no rows for a blank prefix.

    ``mode`` ``recency`` (any case) blends recency in; ``source`` ``TRIE`` answers popularity with normal
    forms. The source given back is ``DB``, ``TRIE`` or ``DB+RECENCY``.
    """
    if (mode or "").lower() == "recency":
        found, kind, label = prefix_recency(dictionary, scores, prefix, k, alpha), "RECENCY", "DB+RECENCY"
    elif source.upper() == "TRIE":
        found, kind, label = norm_top(dictionary, prefix, k), "POPULARITY", "TRIE"
    else:
        found, kind, label = prefix_top(dictionary, prefix, k), "POPULARITY", "DB"
    asked = text.normalize(F.lit(prefix).cast("string"))
    return found.select(asked.alias("prefix"), F.lit(kind).alias("mode"), F.lit(label).alias("source"), "rank", "query", "count")
