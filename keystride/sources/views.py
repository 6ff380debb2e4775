"""Dictionary, event and request views over the driver's test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.functions import text
from keystride.operators.prefix import sort_for_prefixes
from keystride.params import MAX_QUERY_LENGTH
from keystride.session import materialize

# Events name one of the 100 most frequent words by its position, 0 to 99.
POSITIONS = 100
AS_OF = "2024-01-31 00:00:00"  # just after the last event
HALF_LIFE = 259_200.0
NODES_3 = "localhost:6379:0,localhost:6379:1,localhost:6379:2"
NODES_4 = NODES_3 + ",localhost:6379:3"


def searched_queries(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``event_id, ts, user_id, raw, value``; works on a static and on a streaming event table.

    ``raw`` varies in case and padding. A position that is missing, outside the range or beyond a small
    dictionary is an error, not a dropped row.
    """
    order = [F.desc("count"), F.asc("query")]
    frequent = dictionary.select("query", "count").orderBy(*order).limit(POSITIONS)
    # 100 rows at most, kept: each reader of the events would count the dictionary's words again.
    frequent = materialize(frequent.select("query", (F.row_number().over(Window.orderBy(*order)) - 1).alias("k")))
    k = F.get_json_object("props", "$.k").cast("int")
    outside = F.raise_error(F.lit(f"event position names none of the {POSITIONS} most frequent queries"))
    # A null position meets no query either.
    named = events.withColumn("k", k).join(F.broadcast(frequent), "k", "left")
    named = named.withColumn("query", F.coalesce("query", outside.cast("string")))
    turn = F.col("event_id") % 3
    raw = F.when(turn == 0, F.upper("query")).when(turn == 1, F.concat(F.lit("  "), F.col("query"))).otherwise(F.col("query"))
    return named.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", raw.alias("raw"), "value")


def as_requests(searched: DataFrame) -> DataFrame:
    """``req_id, ts, user_id, prefix, took_ms``: the first letters of each search."""
    length = (F.lit(1) + F.col("event_id") % 3).cast("int")
    return searched.select(
        F.col("event_id").alias("req_id"), "ts", "user_id",
        F.substring(text.normalize(F.col("raw")), F.lit(1), length).alias("prefix"),
        F.col("value").alias("took_ms"),
    )


class TestViews:
    """The views of one scale folder, each built when first asked for."""

    __test__ = False
    laid_out = False  # whether the dictionary is stored by normal form

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        # Event times carry no zone; they are read as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def doc_word(self) -> DataFrame:
        return self.all_words.where(~self.overlong & (F.col("w") != ""))

    @cached_property
    def all_words(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.explode(F.split("text", r"[ \n\t]+")).alias("w"))

    @property
    def overlong(self) -> Column:
        """Words that validation rejects as searches."""
        # No text has more units than bytes, and hardly a word has so many bytes.
        return (F.octet_length("w") > MAX_QUERY_LENGTH) & (text.utf16_length(F.col("w")) > MAX_QUERY_LENGTH)

    @cached_property
    def search_query(self) -> DataFrame:
        counted = self.doc_word.groupBy(F.col("w").alias("query")).agg(F.count(F.lit(1)).alias("count"))
        return counted.select("query", text.normalize(F.col("query")).alias("query_norm"), "count")

    @cached_property
    def kept_query(self) -> DataFrame:
        """``search_query`` written once, for jobs that read it several times."""
        return self.search_query if self.laid_out else materialize(self.search_query)

    @cached_property
    def raw_event(self) -> DataFrame:
        return searched_queries(self.table("events"), self.kept_query)

    @cached_property
    def search_event(self) -> DataFrame:
        """``event_id, ts, user_id, query_norm, display``."""
        return self.raw_event.select(
            "event_id", "ts", "user_id", text.normalize(F.col("raw")).alias("query_norm"),
            text.strip(F.col("raw")).alias("display"),
        )

    @cached_property
    def request_log(self) -> DataFrame:
        return as_requests(self.raw_event)

    @cached_property
    def query_line(self) -> DataFrame:
        """``line_no, query, count``: words of one document as lines of one number."""
        return self.doc_word.groupBy(F.col("doc_id").alias("line_no"), F.col("w").alias("query")).agg(
            F.count(F.lit(1)).alias("count")
        )


class StoredViews(TestViews):
    """The same views written once, as a running system would hold them, and read back."""

    NAMES = ("search_query", "raw_event", "query_line")
    laid_out = True

    def __init__(self, spark: SparkSession, folder: str, root: str):
        super().__init__(spark, folder)
        self.root = root
        derived = TestViews(spark, folder)
        for name in self.NAMES:
            frame = getattr(derived, name)
            if name == "search_query":
                frame = sort_for_prefixes(frame).sortWithinPartitions("query_norm", "query")
            frame.write.parquet(f"{root}/{name}")

    @cached_property
    def search_query(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/search_query")

    @cached_property
    def raw_event(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/raw_event")

    @cached_property
    def query_line(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/query_line")
