"""Quantiles and distinct counts over a growing log, from sketches that are kept per batch.

A batch's sketches are a row per group, whatever its size; those of any span of batches are merged when
they are read, so a report over a year reads no event again. A batch that is written again changes
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.operators.reports import QUANTILES
from keystride.sources.batches import BatchTable

KLL_K = 800        # size of a quantile sketch
HLL_LG_K = 14      # binary logarithm of the registers of a distinct sketch


def rank_bound(k: int = KLL_K) -> float:
    """Share of the rows by which a quantile's rank may be off, at 99 % confidence, for sketches of size ``k``."""
    return 2.296 / k ** 0.9723


def distinct_bound(lg_k: int = HLL_LG_K) -> float:
    """Relative error of a distinct count at three standard deviations."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


class LatencySketches:
    """KLL sketches of a duration by group and batch."""

    def __init__(self, spark: SparkSession, root: str, by: Sequence[str] = (), k: int = KLL_K):
        self.by, self.k = list(by), k
        groups = "".join(f"`{c}` string, " for c in self.by)
        self.batches = BatchTable(spark, root, f"{groups}n bigint, total double, sketch binary")

    def add(self, log: DataFrame, batch_id: int, took: str = "took_ms") -> bool:
        """Rows without a duration are left out."""
        rows = log.where(F.col(took).isNotNull()).groupBy(*self.by).agg(
            F.count(F.lit(1)).alias("n"), F.sum(took).alias("total"),
            F.kll_sketch_agg_double(F.col(took).cast("double"), self.k).alias("sketch"))
        return self.batches.write(rows.where("n > 0"), batch_id)

    def quantiles(self, after: int | None = None, through: int | None = None) -> DataFrame:
        """The groups, ``n, p50, p95, p99, mean`` of the batches in a span."""
        merged = self.batches.read(after, through).groupBy(*self.by).agg(
            F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.kll_merge_agg_double("sketch", self.k).alias("sketch"))
        picks = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(q * 100)}") for q in QUANTILES]
        return merged.where("n > 0").select(*self.by, "n", *picks, "mean")


class DistinctSketches:
    """HyperLogLog sketches of a column by batch."""

    def __init__(self, spark: SparkSession, root: str, lg_k: int = HLL_LG_K):
        self.lg_k = lg_k
        self.batches = BatchTable(spark, root, "n bigint, sketch binary")

    def add(self, rows: DataFrame, batch_id: int, column: str = "query_norm") -> bool:
        made = rows.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(column, self.lg_k).alias("sketch"))
        return self.batches.write(made.where("n > 0"), batch_id)

    def count(self, after: int | None = None, through: int | None = None) -> DataFrame:
        """``n, n_distinct`` of the batches in a span."""
        merged = self.batches.read(after, through).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.hll_union_agg("sketch").alias("sketch"))
        return merged.select("n", F.coalesce(F.when(F.col("n") > 0, F.hll_sketch_estimate("sketch")), F.lit(0)).alias("n_distinct"))
