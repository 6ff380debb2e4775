"""Query-count text files: one ``query,count`` per line, read tolerantly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from keystride.functions import text
from keystride.params import MAX_BROADCAST_ROWS
from keystride.session import empty_table

LINE_ORDER = ["file", "block", "line_no"]
_LINES = T.StructType([
    T.StructField("line", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("block", T.LongType()), T.StructField("line_no", T.LongType()),
])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` with its place: file, block of the file, increasing number. No rows if there is no file."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return empty_table(spark, _LINES)
    return raw.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"),
    )


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(r"\S"))


def drop_header(lines: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Drop each file's first non-blank line if it is a ``query,...`` header.

    One scan finds the headers, one row per file at most; while the files are few enough the rows
    are broadcast and the lines stay in place.
    """
    place = F.struct("block", "line_no")
    looks = F.startswith(F.lower("line"), F.lit("query,"))
    firsts = drop_blank(lines).groupBy("file").agg(
        F.min(place).alias("first"), F.min(F.when(looks, place)).alias("header")
    )
    header = firsts.where(F.col("first") == F.col("header")).select("file", "first.block", "first.line_no")
    if len(lines.inputFiles()) <= max_broadcast:
        header = F.broadcast(header)
    return lines.join(header, LINE_ORDER, "left_anti")


def parse(lines: DataFrame) -> DataFrame:
    """Add ``query`` and ``count``; both null on a line that is not a query-count line.

    The last comma separates; the query may be quoted, with inner quotes doubled.
    """
    cut = lines.withColumn("_tail", F.substring_index("line", ",", -1)).withColumn(
        "_head", F.substring(F.col("line"), F.lit(1), F.char_length("line") - F.char_length("_tail") - 1)
    )
    read = cut.withColumn("_count", F.when(F.char_length("_head") > 0, text.parse_long(F.col("_tail"))))
    read = read.withColumn("_text", F.when(F.col("_count").isNotNull(), text.strip(F.col("_head"))))
    query = F.nullif(text.unquote(F.col("_text")), F.lit(""))
    # One-element arrays keep Spark from copying the parser into every filter on its result.
    once = read.select("*", F.explode(F.array(query)).alias("query"))
    count = F.when(F.col("query").isNotNull(), F.col("_count"))
    return once.withColumn("count", count).drop("_tail", "_head", "_count", "_text")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("query").isNotNull()).drop("line")


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines that gave no row, kept for inspection."""
    return parsed.where(F.col("query").isNull()).drop("query", "count")


def read_query_counts(spark: SparkSession, path: str) -> DataFrame:
    """``query, count`` and the line's place, of all good lines under ``path``."""
    return accepted(parse(drop_header(drop_blank(read_lines(spark, path)))))


def write_query_counts(corpus: DataFrame, path: str) -> None:
    """CSV with a header per file; fields with a comma or a quote are quoted, inner quotes doubled."""
    corpus.select("query", "count").write.mode("overwrite").options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def render(corpus: DataFrame) -> DataFrame:
    """The same lines as a column, ``line``."""
    line = F.concat(text.csv_quote(F.col("query")), F.lit(","), F.col("count").cast("string"))
    return corpus.withColumn("line", line)
