"""The registered queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.llm import (
    byte_bpe,
    graph_search,
    hash_index,
    license_join,
    mixing,
    oracle,
    prefix_trie,
    projection_dedup,
    quality,
    simhash,
    token_alignment,
    token_files,
    toxicity,
    url_filter,
)
from keystride.llm.common import fold_of, table
from keystride.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Production parameters.
RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
ALIGNED_TOKENIZERS = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 1
MIX_ENTROPY, MIX_REPETITION, MIX_BLOCKS = 0.95, 4.0, 64
# Fixed values: (verdict, host, path) of url rules.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Domains blocked with their subdomains where no rule fits.
BLOCKED_DOMAINS = (
    "ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net",
    "free-bets.example.net", "spam-farm.example.org",
)
TOXIC_FOLDS, TOXIC_HELD = 5, 0
QUALITY_FOLDS, QUALITY_HELD = 4, 2

ORACLE: dict[str, str] = oracle.build(MIX_ENTROPY, MIX_REPETITION, MIX_BLOCKS, URL_RULES, BLOCKED_DOMAINS)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.where(fold_of(F.col("doc_id"), TOXIC_FOLDS) != TOXIC_HELD))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels.where(fold_of(F.col("doc_id"), QUALITY_FOLDS) != QUALITY_HELD))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity_model(docs, labels), ["doc_id"])
    return scored.select("doc_id", (fold_of(F.col("doc_id"), TOXIC_FOLDS) == TOXIC_HELD).alias("held_out"), "score", "predicted")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which one corpus's worth of tokens is read, sources tempered."""
    counted = materialize(mixing.counted_documents(table(spark, sf_dir, "documents")))
    budget = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    sources = materialize(mixing.plan(counted, MIX_ENTROPY, MIX_REPETITION, budget))
    read = mixing.schedule(counted, sources, blocks=MIX_BLOCKS)
    return read.select(
        F.col("_id").alias("doc_id"), F.when(F.col("_source").startswith("s"), F.substring("_source", 2, 1 << 20)).alias("source"), "pass", "block",
        F.col("offset").alias("source_offset"), F.col("_key").alias("order_key"), "n_tokens")


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    manifest = token_files.write(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), folder, END_ID)
    return token_files.read_documents(manifest, folder)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.range(1).select(F.explode(F.array(*map(F.lit, BLOCKED_DOMAINS))).alias("domain"))
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, domains)


@query
def op5_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents"))[0]


@query
def op6_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.group(table(spark, sf_dir, "embeddings"))


@query
def op7_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ["doc_id"])


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality_model(docs, labels), ["doc_id"])
    return scored.select("doc_id", (fold_of(F.col("doc_id"), QUALITY_FOLDS) == QUALITY_HELD).alias("held_out"), "score", "predicted")


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, ALIGNED_TOKENIZERS)
    return token_alignment.alignment(table(spark, sf_dir, "documents"), a, b, ["doc_id"])


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_index.group(table(spark, sf_dir, "documents"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.share_openings(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))
