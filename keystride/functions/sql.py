"""Suggestions and trending lists as table functions of a session's SQL.

The bodies are SQL over two views, so a call becomes part of the caller's plan; no Python runs in them.

    register(spark, dictionary, scores)
    spark.sql("SELECT * FROM suggest('iph', 'recency', 5)")
    spark.sql("SELECT * FROM trending('recency', 10)")
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystride.functions.scoring import LEVEL_DIGITS, RANK_DIGITS
from keystride.operators.trending import with_level
from keystride.params import ALPHA, K, TRENDING_SIZE

DICTIONARY_VIEW, SCORES_VIEW = "keystride_dictionary", "keystride_scores"


def _blend(by: str = "") -> str:
    """The blended score over candidates with ``count`` and ``level``."""
    share = f"coalesce(round(pow(2.0D, level - max(level) OVER ({by})), {RANK_DIGITS}), 0.0D)"
    popular = f"cast(count AS double) / cast(greatest(1L, max(count) OVER ({by})) AS double)"
    return f"round({ALPHA}D * ({popular}) + {1.0 - ALPHA}D * {share}, {RANK_DIGITS})"


def _suggest() -> str:
    return rf"""
CREATE OR REPLACE TEMPORARY FUNCTION suggest(prefix STRING, mode STRING DEFAULT 'popularity', k INT DEFAULT {K})
RETURNS TABLE (rank INT, query STRING, count BIGINT, source STRING)
RETURN
  WITH asked AS (
    SELECT query, query_norm, count, row_number() OVER (ORDER BY count DESC, query) AS place FROM {DICTIONARY_VIEW}
    WHERE lower(regexp_replace(suggest.prefix, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '')) <> ''
      AND startswith(query_norm, lower(regexp_replace(suggest.prefix, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '')))),
  pooled AS (
    SELECT a.query, a.count, s.level FROM asked a LEFT JOIN {SCORES_VIEW} s ON s.query_norm = a.query_norm
    WHERE a.place <= greatest(5 * suggest.k, 50) AND lower(suggest.mode) = 'recency'),
  blended AS (SELECT query, count, {_blend()} AS blended FROM pooled),
  ranked AS (SELECT row_number() OVER (ORDER BY blended DESC, count DESC, query) AS rank, query, count FROM blended)
  SELECT place, query, count, 'DB' FROM asked WHERE place <= suggest.k AND coalesce(lower(suggest.mode), '') <> 'recency'
  UNION ALL
  SELECT rank, query, count, 'DB+RECENCY' FROM ranked WHERE rank <= suggest.k"""


def _trending() -> str:
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION trending(mode STRING DEFAULT 'recency', size INT DEFAULT {TRENDING_SIZE})
RETURNS TABLE (rank INT, query STRING, count BIGINT, mode STRING, source STRING)
RETURN
  WITH leaders AS (
    SELECT query_norm, level FROM (
      SELECT query_norm, level, row_number() OVER (ORDER BY level DESC, query_norm DESC) AS place FROM {SCORES_VIEW})
    WHERE place <= greatest(3 * trending.size, trending.size)),
  known AS (
    SELECT l.query_norm, max(l.level) AS level, coalesce(max(d.count), 0L) AS count
    FROM leaders l LEFT JOIN {DICTIONARY_VIEW} d ON d.query_norm = l.query_norm GROUP BY l.query_norm),
  blended AS (SELECT query_norm, count, level, {_blend()} AS blended FROM known),
  hot AS (SELECT row_number() OVER (ORDER BY blended DESC, level DESC, query_norm DESC) AS rank, query_norm, count FROM blended),
  popular AS (SELECT row_number() OVER (ORDER BY count DESC, query) AS rank, query, count FROM {DICTIONARY_VIEW})
  SELECT rank, query_norm, count, 'RECENCY', 'COMPUTED' FROM hot
  WHERE rank <= trending.size AND coalesce(lower(trending.mode), '') <> 'popularity'
  UNION ALL
  SELECT rank, query, count, CASE WHEN lower(trending.mode) = 'popularity' THEN 'POPULARITY' ELSE 'RECENCY' END,
    CASE WHEN lower(trending.mode) = 'popularity' THEN 'COMPUTED' ELSE 'FALLBACK_POPULARITY' END
  FROM popular
  WHERE rank <= trending.size AND (coalesce(lower(trending.mode), '') = 'popularity' OR NOT EXISTS (SELECT 1 FROM {SCORES_VIEW}))"""


def register(spark: SparkSession, dictionary: DataFrame, scores: DataFrame) -> None:
    """Define ``suggest(prefix, mode, k)`` and ``trending(mode, size)`` over these tables for the session."""
    dictionary.select("query", "query_norm", "count").createOrReplaceTempView(DICTIONARY_VIEW)
    levels = with_level(scores).where("level IS NOT NULL")
    levels.selectExpr("query_norm", f"round(level, {LEVEL_DIGITS}) AS level").createOrReplaceTempView(SCORES_VIEW)
    spark.sql(_suggest())
    spark.sql(_trending())
