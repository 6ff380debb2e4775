"""Effect reports: hit rate, store traffic, latency, table statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.functions import scoring
from keystride.operators.ordered import null_safe_join, row_numbers
from keystride.params import MAX_GROUP_ROWS

# The reported quantiles.
QUANTILES = (0.50, 0.95, 0.99)


def _count_if(condition):
    return F.count(F.when(condition, F.lit(1)))


def hit_rate(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``hits, misses, hit_rate`` of a request log with a ``source`` column; 0 for an empty log.

    Requests that needed no list (``EMPTY``) count as neither.
    """
    hit = F.col("source").isin("CACHE", "MATERIALIZED")
    asked = hit | F.col("source").isin("COMPUTED", "DB", "TRIE", "DB+RECENCY")
    counted = log.groupBy(*by).agg(_count_if(hit).alias("hits"), _count_if(asked & ~hit).alias("misses"))
    rate = F.try_divide(F.col("hits"), F.col("hits") + F.col("misses"))
    return counted.withColumn("hit_rate", F.coalesce(scoring.half_up(rate), F.lit(0.0)))


def store_traffic(log: DataFrame, folded: DataFrame) -> DataFrame:
    """``reads, writes``: list computations that read the dictionary, and rows upserted into it."""
    read = F.col("source").isin("COMPUTED", "DB", "DB+RECENCY")
    reads = log.select(read.cast("bigint").alias("reads"), F.lit(0).cast("bigint").alias("writes"))
    writes = folded.select(F.lit(0).cast("bigint").alias("reads"), F.lit(1).cast("bigint").alias("writes"))
    zero = F.lit(0).cast("bigint")
    return reads.unionByName(writes).agg(
        F.coalesce(F.sum("reads"), zero).alias("reads"), F.coalesce(F.sum("writes"), zero).alias("writes")
    )


def latency(log: DataFrame, rule: str = "floor_n", took: str = "took_ms", request_id: str = "req_id",
            by: Sequence[str] = (), max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``n, p50, p95, p99, mean`` by exact element pick, for each group, a null one too.

    ``floor_n`` picks element ``int(q * n)`` counted from 1 (0 when there is none); ``floor_n_1``
    picks element ``floor(q * (n - 1))`` counted from 0.
    """
    return latencies(log, [rule], took, request_id, by, max_group_rows).drop("rule")


def latencies(log: DataFrame, rules: Sequence[str], took: str = "took_ms", request_id: str = "req_id",
              by: Sequence[str] = (), max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``rule`` and the columns of ``latency``; rows are numbered once for all rules.

    Groups are few and their picks three per rule, so the picks are joined to the numbered rows by
    group and number; a group that holds a third of the log is not gathered by its key.
    """
    if unknown := set(rules) - {"floor_n", "floor_n_1"}:
        raise ValueError(f"unknown rule {unknown.pop()!r}")
    by = list(by)
    placed = row_numbers(log.select(*by, took, request_id), by, [F.asc(took), F.asc(request_id)], "_n", max_group_rows)
    totals = log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(took).alias("mean"))

    def wanted(rule: str, q: float):
        if rule == "floor_n":
            return F.floor(F.lit(q) * F.col("n").cast("double"))
        return F.floor(F.lit(q) * (F.col("n") - 1).cast("double")) + 1

    picks = totals.select(*by, F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(q).alias("q"), wanted(rule, q).alias("_n")) for rule in rules for q in QUANTILES
    ])).alias("p")).select(*by, "p.*")
    found = null_safe_join(placed.select(*by, "_n", took), picks, [*by, "_n"]).select(*by, "rule", "q", took)
    every = totals.select(*by, F.explode(F.array(*map(F.lit, rules))).alias("rule"), "n", "mean")
    both = every.unionByName(found, allowMissingColumns=True)
    columns = [
        F.coalesce(F.max(F.when(F.col("q") == q, F.col(took))), F.lit(0.0)).alias(f"p{round(q * 100)}") for q in QUANTILES
    ]
    return both.groupBy(*by, "rule").agg(F.max("n").alias("n"), *columns, F.max("mean").alias("mean"))


def latency_approximate(log: DataFrame, took: str = "took_ms", by: Sequence[str] = (),
                        accuracy: int = 10_000) -> DataFrame:
    """As ``latency`` from a mergeable sketch, in one pass and without sorting."""
    quantiles = F.percentile_approx(took, list(QUANTILES), accuracy)
    names = [f"p{round(q * 100)}" for q in QUANTILES]
    summed = log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), quantiles.alias("q"), F.avg(took).alias("mean"))
    return summed.select(*by, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(names)], "mean")


def table_statistics(dictionary: DataFrame, exact: bool = True) -> DataFrame:
    """``rows, norms, total``: rows, distinct normal forms and summed counts of the dictionary."""
    if exact:
        # Grouping first keeps the distinct count parallel and folds repeated forms early.
        norms = dictionary.groupBy("query_norm").agg(F.count(F.lit(1)).alias("r"), F.sum("count").alias("c"))
        return norms.agg(
            F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("norms"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
        )
    return dictionary.agg(
        F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("query_norm").alias("norms"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
    )
