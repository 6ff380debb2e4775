"""Completion lists kept up to date as counts change, without ranking every prefix again.

Each prefix has a buffer: its best ``k`` completions and some spare ones, and the floor, which is the last
completion buffered when more were left out. Whatever is not in the buffer ranks below the floor, so a
change is decided by the buffer alone: a completion whose new count ranks at or above the floor is in,
one below it is out. Only where completions sink and fewer than ``k`` remain above the floor must a prefix
be ranked anew from the dictionary; the spare rows make that rare.

Buffer columns: ``prefix, query, count, floor_count, floor_query, complete``; ``complete`` says that
nothing was left out, and then there is no floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.operators.prefix import all_prefix_top, allow_group_limit, explode_prefixes
from keystride.params import K, MAX_BROADCAST_ROWS
from keystride.session import materialize
from keystride.sources.ranges import TARGET_ROWS, DictionaryRanges, RangeTable

BUFFER = "prefix string, query string, count bigint, floor_count bigint, floor_query string, complete boolean"
COLUMNS = ["prefix", "query", "count", "floor_count", "floor_query", "complete"]
SPARE = 10


def _by_prefix():
    return Window.partitionBy("prefix")


def _with_floor(ranked: DataFrame, size: int, n: Column, complete: Column, old_floor: Column | None = None) -> DataFrame:
    """Cut ranked rows to ``size`` a prefix; a prefix with more gets its last row as the floor."""
    last = F.max(F.when(F.col("rank") == size, F.struct(F.col("count").alias("c"), F.col("query").alias("q")))).over(_by_prefix())
    floor = F.when(n > size, last) if old_floor is None else F.when(n > size, last).otherwise(old_floor)
    rows = ranked.withColumn("_floor", floor).withColumn("complete", complete & (n <= size)).where(F.col("rank") <= size)
    return rows.select("prefix", "query", "count", F.col("_floor.c").alias("floor_count"), F.col("_floor.q").alias("floor_query"), "complete")


def build_buffers(dictionary: DataFrame, k: int = K, spare: int = SPARE, wanted: DataFrame | None = None) -> DataFrame:
    """Buffers of every prefix of the dictionary, or of the ``wanted`` ones."""
    size = k + spare
    ranked = all_prefix_top(dictionary, size + 1, wanted=wanted)
    return _with_floor(ranked, size, F.max("rank").over(_by_prefix()), F.lit(True))


def lists(buffers: DataFrame, k: int = K) -> DataFrame:
    """``prefix, rank, query, count``: the best ``k`` of each buffer."""
    rank = F.row_number().over(_by_prefix().orderBy(F.desc("count"), F.asc("query")))
    return buffers.withColumn("rank", rank).where(F.col("rank") <= k).select("prefix", "rank", "query", "count")


def spread_changes(changed: DataFrame, size: int) -> DataFrame:
    """``prefix, query, count``: of each prefix the changed rows that may enter its buffer.

    ``changed`` has ``query, query_norm, count`` as they are now; more than ``size + 1`` of a prefix cannot
    matter, and the rank filter drops the others before they are shuffled.
    """
    allow_group_limit(changed, size + 1)
    spread = explode_prefixes(changed.select("query", "query_norm", "count"))
    rank = F.row_number().over(_by_prefix().orderBy(F.desc("count"), F.asc("query")))
    return spread.withColumn("_n", rank).where(F.col("_n") <= size + 1).select("prefix", "query", "count")


def apply_changes(buffers: DataFrame, entering: DataFrame, changed: DataFrame, k: int = K, spare: int = SPARE) -> DataFrame:
    """Buffers after a change, with ``dry``: whether the prefix must be ranked anew.

    ``changed`` names the queries whose counts are no longer those of the buffers, deleted ones too;
    ``entering`` are their new counts by prefix. The rows of a dry prefix are not to be used.
    """
    size = k + spare
    names = changed.select("query").distinct().withColumn("stale", F.lit(True))
    few = names.count() <= MAX_BROADCAST_ROWS
    old = buffers.join(F.broadcast(names) if few else names, "query", "left").select(
        *COLUMNS, F.coalesce("stale", F.lit(False)).alias("stale"))
    none = [F.lit(None).cast("bigint"), F.lit(None).cast("string"), F.lit(None).cast("boolean")]
    new = entering.select("prefix", "query", "count", *[c.alias(n) for c, n in zip(none, COLUMNS[3:], strict=True)], F.lit(False).alias("stale"))
    # At most two buffers of a prefix meet here.
    floor = F.max(F.when(F.col("floor_count").isNotNull(), F.struct(F.col("floor_count").alias("c"), F.col("floor_query").alias("q")))).over(_by_prefix())
    # A prefix without a buffer had no completion at all.
    whole = F.coalesce(F.min("complete").over(_by_prefix()), F.lit(True))
    both = old.unionByName(new).withColumn("_old", floor).withColumn("_whole", whole)
    above = (F.col("count") > F.col("_old.c")) | ((F.col("count") == F.col("_old.c")) & (F.col("query") <= F.col("_old.q")))
    both = both.withColumn("_live", ~F.col("stale") & (F.col("_whole") | above))
    both = both.withColumn("_n", F.sum(F.col("_live").cast("int")).over(_by_prefix()))
    rank = F.row_number().over(_by_prefix().orderBy(F.desc("_live"), F.desc("count"), F.asc("query")))
    ranked = both.withColumn("rank", rank).withColumn("dry", ~F.col("_whole") & (F.col("_n") < k))
    last = F.max(F.when(F.col("_live") & (F.col("rank") == size), F.struct(F.col("count").alias("c"), F.col("query").alias("q")))).over(_by_prefix())
    cut = F.col("_n") > size
    out = ranked.withColumn("_floor", F.when(cut, last).otherwise(F.col("_old"))).withColumn("complete", F.col("_whole") & ~cut)
    # One row of a dry prefix stays to name it, whatever became of its completions.
    out = out.where((F.col("_live") & (F.col("rank") <= size)) | (F.col("dry") & (F.col("rank") == 1)))
    return out.select("prefix", "query", "count", F.col("_floor.c").alias("floor_count"), F.col("_floor.q").alias("floor_query"), "complete", "dry")


class PrefixLists(RangeTable):
    """The buffers of all prefixes, stored in ranges of prefixes."""

    def __init__(self, spark: SparkSession, root: str, k: int = K, spare: int = SPARE, target_rows: int = TARGET_ROWS):
        super().__init__(spark, root, BUFFER, "prefix", target_rows)
        self.k, self.spare = k, spare

    def build(self, dictionary: DictionaryRanges) -> None:
        """Rank every prefix; from then on ``update`` keeps the lists."""
        self.load(build_buffers(dictionary.read(), self.k, self.spare), dictionary.through())

    def update(self, dictionary: DictionaryRanges, changed: DataFrame, batch_id: int | None = None) -> int:
        """Bring the prefixes of the changed queries (``query, query_norm``) up to date.

        The dictionary must hold their new counts already. Returns how many prefixes had to be ranked anew.
        """
        anew = 0
        changed = materialize(changed.select("query", "query_norm").distinct())
        now = materialize(dictionary.rows_of(changed).select("query", "query_norm", "count"))
        entering = spread_changes(now, self.k + self.spare)
        deleted = changed.join(now.select("query"), "query", "left_anti")
        # Prefixes of a deleted query have nothing entering but lose a row.
        gone = explode_prefixes(deleted).select("prefix", "query", F.lit(None).cast("bigint").alias("count"))

        def combine(buffers: DataFrame, entering: DataFrame) -> DataFrame:
            nonlocal anew
            # A few prefixes of a range change; the others' buffers are written again as they are.
            met = materialize(entering.select("prefix").distinct())
            met = F.broadcast(met) if met.count() <= MAX_BROADCAST_ROWS else met
            same, buffers = (buffers.join(met, "prefix", how).select(*COLUMNS) for how in ("left_anti", "left_semi"))
            after = materialize(apply_changes(buffers, entering.where("count is not null"), changed, self.k, self.spare))
            dry = materialize(after.where("dry").select("prefix").distinct())
            anew = dry.count()
            if not anew:
                return same.unionByName(after.drop("dry"))
            fresh = build_buffers(dictionary.read_for(dry, "prefix", beginnings=True), self.k, self.spare, wanted=dry)
            return same.unionByName(after.where("not dry").drop("dry")).unionByName(fresh)

        self.merge(entering.unionByName(gone), "prefix", combine, batch_id)
        return anew

    def lists(self) -> DataFrame:
        return lists(self.read(), self.k)
