"""Text expressions. Everything stays in the JVM; no expression here needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystride.params import MAX_QUERY_LENGTH

# Code points U+0000 to U+0020, the only ones stripped at both ends.
STRIPPED = "".join(chr(c) for c in range(0x21))

LIST_TYPE = "array<struct<query:string,count:bigint>>"


def strip(text: Column) -> Column:
    """Drop control characters and spaces at both ends; other Unicode spaces stay."""
    return F.btrim(text, F.lit(STRIPPED))


def normalize(text: Column) -> Column:
    """Matching form of a query: null becomes empty, ends stripped, lower case."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def escape_like(text: Column) -> Column:
    """Escape a user text for ``LIKE ... ESCAPE '\\'``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("%"), F.lit("\\%"))
    return F.replace(out, F.lit("_"), F.lit("\\_"))


def suggest_key(prefix: Column) -> Column:
    return F.concat(F.lit("suggest:"), prefix)


def recency_key(prefix: Column) -> Column:
    return F.concat(F.lit("suggest:recency:"), prefix)


def list_key(prefix: Column, mode: Column) -> Column:
    return F.when(mode == "RECENCY", recency_key(prefix)).otherwise(suggest_key(prefix))


def suggest_mode(mode: Column) -> Column:
    """Only ``recency`` (any case) selects recency; all else, null too, is popularity."""
    asked = F.lower(F.coalesce(mode, F.lit("")))
    return F.when(asked == "recency", "RECENCY").otherwise("POPULARITY")


def trending_mode(mode: Column) -> Column:
    """Only ``popularity`` (any case) selects popularity; all else, null too, is recency."""
    asked = F.lower(F.coalesce(mode, F.lit("")))
    return F.when(asked == "popularity", "POPULARITY").otherwise("RECENCY")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def query_error(query: Column, limit: int = MAX_QUERY_LENGTH) -> Column:
    """All violated rules as ``query: message`` joined by ``; ``; null for a valid query."""
    blank = F.when(query.isNull() | is_blank(query), "query: must not be blank")
    too_long = F.when(utf16_length(query) > limit, f"query: length must be at most {limit}")
    return F.nullif(F.concat_ws("; ", blank, too_long), F.lit(""))


def parse_long(text: Column) -> Column:
    """Signed decimal 64-bit integer, or null. Accepts ASCII digits only."""
    stripped = strip(text)
    return F.when(stripped.rlike(r"^[+-]?[0-9]+\z"), stripped.try_cast("bigint"))


def unquote(text: Column) -> Column:
    """Remove one pair of surrounding double quotes and un-double the inner ones."""
    inner = F.substring(text, F.lit(2), F.char_length(text) - 2)
    quoted = (F.char_length(text) >= 2) & F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))
    return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(text)


def csv_quote(text: Column) -> Column:
    """Quote a CSV field that holds a comma or a quote."""
    needs = F.contains(text, F.lit(",")) | F.contains(text, F.lit('"'))
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(needs, doubled).otherwise(text)


def prefixes(norm: Column, max_length: Column | int | None = None) -> Column:
    """All prefixes of 1 to ``max_length`` characters; an empty array for an empty text."""
    last = F.char_length(norm)
    if max_length is not None:
        last = F.least(last, F.lit(max_length))
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.substring(norm, F.lit(1), i))


def list_to_json(items: Column) -> Column:
    return F.to_json(items)


def list_from_json(text: Column) -> Column:
    return F.from_json(text, LIST_TYPE)
