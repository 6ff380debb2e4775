"""Corpus pipeline: quality, toxicity, near-duplicates, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.llm import byte_bpe, mixing, quality, simhash, toxicity
from keystride.llm.common import table
from keystride.llm.queries import RANKS, quality_model, toxicity_model
from keystride.session import materialize

# The mix reads every kept document once and no source more than twice.
MIX_ENTROPY, MIX_REPETITION = 0.9, 2.0


def _whole(docs: DataFrame) -> DataFrame:
    """The text, and the row as one column, so that no name of it can clash with a score's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.score(_whole(docs), model, ["row"]).where("predicted = 1").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_whole(docs), model, ["row"]).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, target_entropy=MIX_ENTROPY, max_repetition=MIX_REPETITION)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(
        docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ["doc_id", "source", "lang"], with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

# Models and restored texts have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
