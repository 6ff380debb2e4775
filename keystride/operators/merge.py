"""Maintaining the dictionary: additive merge, last-line-wins load.

Dictionary columns: ``query``, ``query_norm``, ``count``, ``last_searched_at``, ``created_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystride.functions import text

DICTIONARY = T.StructType([
    T.StructField("query", T.StringType(), False),
    T.StructField("query_norm", T.StringType(), False),
    T.StructField("count", T.LongType(), False),
    T.StructField("last_searched_at", T.TimestampType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])


def deltas_as_rows(folded: DataFrame) -> DataFrame:
    """Folded deltas in the dictionary's shape; the display becomes the key."""
    return folded.select(
        F.col("display").alias("query"), "query_norm", F.col("delta").alias("count"),
        F.col("last_ts").alias("last_searched_at"), F.col("last_ts").alias("created_at"),
    )


def upsert(base: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Add counts per query; keep the earliest creation and its normal form, the latest search.

    Addition commutes, so a union and one aggregation replace the keyed update; all deltas of any
    number of batches merge in the same single shuffle.
    """
    rows = base.select(*DICTIONARY.names)
    for delta in deltas:
        rows = rows.unionByName(delta.select(*DICTIONARY.names))
    return rows.groupBy("query").agg(
        F.min_by("query_norm", "created_at").alias("query_norm"),
        F.sum("count").alias("count"),
        F.max("last_searched_at").alias("last_searched_at"),
        F.min("created_at").alias("created_at"),
    ).select(*DICTIONARY.names)


def last_line_wins(lines: DataFrame, order: list[str | Column]) -> DataFrame:
    """One row per query: the line that comes last in ``order``.

    An aggregation, not a window: a query repeated on a third of the lines folds before the shuffle. By
    one column, lines without a number coming first, each column has an aggregate of its own, all of
    which choose the same line: numbers are then folded by hashing, where structs would be sorted.
    """
    others = [c for c in lines.columns if c != "query"]
    if len(order) > 1 or not isinstance(order[0], str):
        last = F.max_by(F.struct(*others), F.struct(*order))
        return lines.groupBy("query").agg(last.alias("_last")).select("query", "_last.*")
    key = F.col(order[0])
    unnumbered = F.when(key.isNull(), F.lit(True))
    lasts = [F.when(F.count(key) > 0, F.max_by(c, key)).otherwise(F.max_by(c, unnumbered)).alias(c) for c in others]
    return lines.groupBy("query").agg(*lasts)


def as_dictionary(lines: DataFrame, loaded_at: Column) -> DataFrame:
    """Parsed lines (``query``, ``count``) in the dictionary's shape."""
    at = loaded_at.cast("timestamp")
    return lines.select(
        "query", text.normalize(F.col("query")).alias("query_norm"), "count",
        at.alias("last_searched_at"), at.alias("created_at"),
    )
