"""Decayed scores and trending lists.

Event columns: ``query_norm``, ``ts``. Score table columns: ``query_norm``, ``score``, ``level``, ``ref_ts``.
A score is the sum over the searches of a query of a weight that halves every half-life; ``level`` is its
binary logarithm. A score fades to zero some thousand half-lives after the last search, its level does
not, so ranking goes by level.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.functions import scoring
from keystride.operators import prefix
from keystride.params import ALPHA, HALF_LIFE_SECONDS, TRENDING_SIZE, leader_count
from keystride.session import materialize

Moment = dt.datetime | str


# Half-lives per epoch: weights up to 2**512 fit a double with room to spare.
_EPOCH_HALF_LIVES = 512


def _summed(weighted: DataFrame, now: Column, half_life: float) -> DataFrame:
    """Scores and levels at ``now`` of rows ``query_norm, us, value``.

    Weights grow from the start of the row's epoch, so none is lost; the few epochs of a query are
    added relative to its last one. The second grouping sees a row per query and epoch.
    """
    seconds = F.col("us") / F.lit(1e6)
    span = _EPOCH_HALF_LIVES * half_life
    epoch = F.floor(seconds / F.lit(span))
    grown = F.col("value") * F.pow(F.lit(2.0), (seconds - F.col("_epoch") * F.lit(span)) / F.lit(half_life))
    seen = F.col("value") * scoring.decay(scoring.age_seconds(F.col("us"), now), half_life)
    per_epoch = weighted.withColumn("_epoch", epoch).groupBy("query_norm", "_epoch").agg(
        F.sum(grown).alias("_grown"), F.sum(seen).alias("score"))
    epochs = per_epoch.groupBy("query_norm").agg(
        F.sum("score").alias("score"), F.max("_epoch").alias("_last"),
        F.collect_list(F.struct("_epoch", "_grown")).alias("_parts"))  # one entry per epoch of the history
    total = F.aggregate("_parts", F.lit(0.0), lambda acc, e: acc + e["_grown"] * F.pow(
        F.lit(2.0), ((e["_epoch"] - F.col("_last")) * _EPOCH_HALF_LIVES).cast("double")))
    level = F.log2(total) + (F.col("_last") * F.lit(span) - now / F.lit(1e6)) / F.lit(half_life)
    return epochs.select("query_norm", "score", level.alias("level"), F.timestamp_micros(now).alias("ref_ts"))


def decayed_scores(events: DataFrame, as_of: Moment, half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """Score of every query as seen at ``as_of``; later events are ignored."""
    now = scoring.as_micros(as_of)
    at = F.unix_micros("ts")
    rows = events.where(at <= now).select("query_norm", at.alias("us"), F.lit(1.0).alias("value"))
    return _summed(rows, now, half_life)


def with_level(scores: DataFrame) -> DataFrame:
    """A score table that may come without levels."""
    if "level" in scores.columns:
        return scores
    return scores.withColumn("level", F.when(F.col("score") > 0, F.log2("score")))


def reanchor(scores: DataFrame, as_of: Moment, half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """Move scores to another reference time; their order does not change."""
    now = scoring.as_micros(as_of)
    age = scoring.age_seconds(F.unix_micros("ref_ts"), now)
    return with_level(scores).select(
        "query_norm",
        (F.col("score") * scoring.decay(age, half_life)).alias("score"),
        (F.col("level") - age / F.lit(half_life)).alias("level"),
        F.timestamp_micros(now).alias("ref_ts"),
    )


def add_scores(scores: DataFrame, more: DataFrame, as_of: Moment,
               half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """Sum two score tables at a common reference time."""
    both = reanchor(scores, as_of, half_life).unionByName(reanchor(more, as_of, half_life))
    summed = both.groupBy("query_norm").agg(
        F.sum("score").alias("score"), F.max("level").alias("_top"), F.max("ref_ts").alias("ref_ts"),
        F.collect_list("level").alias("_levels"))  # an entry per table
    total = F.aggregate("_levels", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(2.0), x - F.col("_top")))
    return summed.select("query_norm", "score", (F.col("_top") + F.log2(total)).alias("level"), "ref_ts")


def score_partials(events: DataFrame, width: str = "1 hour", half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """``query_norm, window_end, partial``: per-window sums, weighted as seen at the window's end.

    Works on a static and on a watermarked streaming frame.
    """
    span = F.window("ts", width)
    spanned = events.select("query_norm", "ts", span.alias("w"))
    age = scoring.age_seconds(F.unix_micros("ts"), F.unix_micros("w.end"))
    return (
        spanned.groupBy("query_norm", "w")
        .agg(F.sum(scoring.decay(age, half_life)).alias("partial"))
        .select("query_norm", F.col("w.end").alias("window_end"), "partial")
    )


def scores_from_partials(partials: DataFrame, as_of: Moment, half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """Total score at ``as_of`` from windows that have ended by then."""
    now = scoring.as_micros(as_of)
    at = F.unix_micros("window_end")
    return _summed(partials.where(at <= now).select("query_norm", at.alias("us"), F.col("partial").alias("value")), now, half_life)


def best_of_norm(dictionary: DataFrame) -> DataFrame:
    """``query_norm, display, count``: the most searched variant of each normal form."""
    best = F.min_by("query", F.struct(-F.col("count"), F.col("query")))
    return dictionary.groupBy("query_norm").agg(best.alias("display"), F.max("count").alias("count"))


def score_leaders(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest scores; ties go to the larger text."""
    settled = with_level(scores).select("query_norm", "score", scoring.settled_level(F.col("level")).alias("level"))
    return settled.orderBy(F.desc("level"), F.desc("query_norm")).limit(n)


def trending_popularity(dictionary: DataFrame, size: int = TRENDING_SIZE) -> DataFrame:
    top = prefix.global_top(dictionary, size)
    return top.withColumn("mode", F.lit("POPULARITY")).withColumn("source", F.lit("COMPUTED"))


def trending_recency(dictionary: DataFrame, scores: DataFrame, size: int = TRENDING_SIZE,
                     alpha: float = ALPHA) -> DataFrame:
    """``rank, query, display, count, score, level, blended, mode, source`` over the score leaders.

    With an empty score table the popularity list is returned, labelled as the fallback; both
    branches are part of one plan.
    """
    leaders = score_leaders(scores, leader_count(size))
    # At most leader_count rows: the dictionary is filtered in place, not shuffled.
    known = dictionary.join(F.broadcast(leaders.select("query_norm")), "query_norm")
    scored = leaders.join(best_of_norm(known), "query_norm", "left").select(
        "query_norm", "display", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), "score", "level"
    )
    everyone = Window.partitionBy()  # leader_count rows
    share = scoring.share_of(F.col("level"), F.max("level").over(everyone))
    blended = scoring.blend(F.col("count"), F.max("count").over(everyone), share, F.lit(1.0), alpha)
    order = [F.desc("blended"), F.desc("level"), F.desc("query_norm")]
    ranked = scored.withColumn("blended", scoring.settled(blended)).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order))
    )
    hot = ranked.where(F.col("rank") <= size).select(
        "rank", F.col("query_norm").alias("query"), "display", "count", "score", "level", "blended",
        F.lit("COMPUTED").alias("source"),
    )
    none_scored = scores.select(F.lit(1).alias("one")).limit(1).agg(F.count("one")).scalar() == 0
    cold = prefix.global_top(dictionary.where(none_scored), size).select(
        "rank", "query", F.col("query").alias("display"), "count",
        F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("blended"),
        F.lit("FALLBACK_POPULARITY").alias("source"),
    )
    return hot.unionByName(cold).withColumn("mode", F.lit("RECENCY"))


def trending(dictionary: DataFrame, scores: DataFrame, mode: str = "recency", size: int = TRENDING_SIZE,
             alpha: float = ALPHA) -> DataFrame:
    """``rank, query, count, mode, source``; only ``popularity`` (any case) leaves recency out."""
    if (mode or "").lower() == "popularity":
        top = trending_popularity(dictionary, size)
    else:
        top = trending_recency(dictionary, scores, size, alpha)
    return top.select("rank", "query", "count", "mode", "source")


def running_scores(partials: DataFrame, half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """Add ``score``: the query's decayed score at each of its windows, this one included.

    A running sum needs weights that grow with time, which overflow on long histories. They are
    therefore anchored at the start of an epoch, and what earlier epochs leave behind is carried
    in, decayed. An epoch three back weighs under 2**-1024 and has left the range of a double.
    """
    seconds = F.unix_micros("window_end") / F.lit(1e6)
    span = _EPOCH_HALF_LIVES * half_life
    placed = partials.select(
        "*", F.floor(seconds / F.lit(span)).alias("_epoch"), seconds.alias("_at")
    ).withColumn("_halves", (F.col("_at") - F.col("_epoch") * F.lit(span)) / F.lit(half_life))
    grown = F.col("partial") * F.pow(F.lit(2.0), F.col("_halves"))
    epochs = placed.groupBy("query_norm", "_epoch").agg(F.sum(grown).alias("_grown"))
    back = Window.partitionBy("query_norm").orderBy("_epoch").rangeBetween(-2, -1)
    left = F.aggregate(
        F.collect_list(F.struct("_epoch", "_grown")).over(back),  # two entries at most
        F.lit(0.0),
        lambda acc, e: acc + e["_grown"] * F.pow(
            F.lit(2.0), (e["_epoch"] - F.col("_epoch")).cast("double") * F.lit(float(_EPOCH_HALF_LIVES))
        ),
    )
    carried = epochs.select("query_norm", "_epoch", left.alias("_carry"))
    sofar = Window.partitionBy("query_norm", "_epoch").orderBy("window_end").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    total = (F.sum(grown).over(sofar) + F.col("_carry")) * F.pow(F.lit(2.0), -F.col("_halves"))
    return placed.join(carried, ["query_norm", "_epoch"]).withColumn("score", total).drop(
        "_epoch", "_at", "_halves", "_carry"
    )


def _whole_blocks(first: Column, end: Column, levels: int) -> Column:
    """Split ``[first, end)`` into aligned blocks of power-of-two length, two per level at most."""
    def at_level(level: Column) -> Column:
        def inside(lv: Column) -> tuple[Column, Column]:
            size = F.pow(F.lit(2.0), lv).cast("bigint")
            return F.ceil(first / size), F.floor(end / size)

        lo, hi = inside(level)
        up_lo, up_hi = inside(level + 1)
        parent = up_hi > up_lo
        left_end = F.when(parent, F.least(2 * up_lo, hi)).otherwise(hi)
        right_start = F.when(parent, F.greatest(2 * up_hi, lo)).otherwise(hi)
        none = F.array().cast("array<bigint>")
        left = F.when((hi > lo) & (left_end > lo), F.sequence(lo, left_end - 1)).otherwise(none)
        right = F.when((hi > lo) & (hi > right_start), F.sequence(right_start, hi - 1)).otherwise(none)
        return F.transform(F.concat(left, right), lambda b: F.struct(level.alias("level"), b.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at_level))


def trending_snapshots(partials: DataFrame, dictionary: DataFrame, first: Moment, last: Moment,
                       every_seconds: int, size: int = TRENDING_SIZE, alpha: float = ALPHA,
                       half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """Trending list at every ``every_seconds`` from ``first`` to ``last``.

    Partials must be windows of ``every_seconds``. Between two of its own windows a query's score
    only decays, as all scores do, so one row stands for a whole run of snapshots. Each run is
    split into aligned blocks of power-of-two length, the leaders of each block are kept, and
    snapshots are drawn from the few blocks above them. The work grows with the number of
    (query, window) pairs, not with queries times snapshots.
    """
    start, stop = scoring.as_micros(first), scoring.as_micros(last)
    step = every_seconds * 1_000_000
    snapshots = F.floor((stop - start) / F.lit(step)) + 1
    moments = [m if isinstance(m, dt.datetime) else dt.datetime.fromisoformat(m) for m in (first, last)]
    count = int((moments[1] - moments[0]).total_seconds() // every_seconds) + 1
    levels = max(1, math.ceil(math.log2(count + 1)))
    n = leader_count(size)

    running = running_scores(partials, half_life)
    # First snapshot that sees the window, and the first one that sees the query's next window.
    seen = F.greatest(F.ceil((F.unix_micros("window_end") - start) / F.lit(step)), F.lit(0).cast("bigint"))
    following = F.lead("seen").over(Window.partitionBy("query_norm").orderBy("window_end"))
    runs = (
        running.withColumn("seen", seen)
        .withColumn("until", F.least(F.coalesce(following, snapshots), snapshots))
        .where(F.col("seen") < F.col("until"))
    )
    # log2 of the score, as if it never decayed: comparable between all runs of a block.
    level_score = F.log2("score") + (F.unix_micros("window_end") - start) / F.lit(1e6 * half_life)
    blocks = runs.select(
        "query_norm", "window_end", "score", scoring.settled_level(level_score).alias("level_score"),
        F.explode(_whole_blocks(F.col("seen"), F.col("until"), levels)).alias("b"),
    )
    order = [F.desc("level_score"), F.desc("query_norm")]
    kept = blocks.withColumn(
        "_r", F.row_number().over(Window.partitionBy("b.level", "b.block").orderBy(*order))
    ).where(F.col("_r") <= n)
    width = F.pow(F.lit(2.0), F.col("b.level")).cast("bigint")
    drawn = kept.select(
        "query_norm", "window_end", "score", "level_score",
        F.explode(F.sequence(F.col("b.block") * width, (F.col("b.block") + 1) * width - 1)).alias("snapshot"),
    ).withColumn("_r", F.row_number().over(Window.partitionBy("snapshot").orderBy(*order))).where(F.col("_r") <= n)

    at = start + F.col("snapshot") * F.lit(step)
    age = scoring.age_seconds(F.unix_micros("window_end"), at)
    decayed = scoring.settled(F.col("score") * scoring.decay(age, half_life))
    leaders = materialize(drawn.select("snapshot", "query_norm", decayed.alias("score"), "level_score"))
    # leader_count names per snapshot at most: the dictionary is cut to them before it is grouped.
    popular = prefix.per_norm(dictionary.join(leaders.select("query_norm").distinct(), "query_norm", "left_semi"))
    scored = leaders.join(popular, "query_norm", "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("bigint"))
    )
    per = Window.partitionBy("snapshot")
    share = scoring.share_of(F.col("level_score"), F.max("level_score").over(per))
    blended = scoring.settled(scoring.blend(F.col("count"), F.max("count").over(per), share, F.lit(1.0), alpha))
    final = [F.desc("blended"), F.desc("level_score"), F.desc("query_norm")]
    ranked = scored.withColumn("blended", blended).withColumn("rank", F.row_number().over(per.orderBy(*final)))
    hot = ranked.where(F.col("rank") <= size).select(
        "snapshot", "rank", F.col("query_norm").alias("query"), "count", "score", "blended", F.lit("COMPUTED").alias("source"))
    # Snapshots before the first score show the popularity list; its ``size`` rows are one array.
    top = prefix.global_top(dictionary, size).agg(F.array_sort(F.collect_list(F.struct("rank", "query", "count"))))
    every = dictionary.sparkSession.range(count).select(F.col("id").alias("snapshot"))
    bare = every.join(leaders.select("snapshot").distinct(), "snapshot", "left_anti")
    cold = bare.withColumn("top", top.scalar()).select("snapshot", F.inline("top")).select(
        "snapshot", "rank", "query", "count", F.lit(0.0).alias("score"), F.lit(0.0).alias("blended"),
        F.lit("FALLBACK_POPULARITY").alias("source"))
    moment = F.timestamp_micros(start + F.col("snapshot") * F.lit(step))
    return hot.unionByName(cold).withColumn("as_of", moment).select(
        "snapshot", "as_of", "rank", "query", "count", "score", "blended", "source")
