import hashlib

import pytest
from pyspark.sql import functions as F

from keystride.functions import hashing, scoring, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, wanted", [
    (None, ""), ("", ""), ("\t a \n", "a"), ("　x　", "　x　"), ("  MiXed  Case ", "mixed  case"),
    ("a  ", "a  "), ("\x00\x1fq\x00", "q"), ("İ", "i̇"), ("ΟΣ", "ος"),
])
def test_normalize(spark, raw, wanted):
    assert one(spark, raw, text.normalize) == wanted


@pytest.mark.parametrize("raw, wanted", [("a%b", "a\\%b"), ("a_b", "a\\_b"), ("a\\b", "a\\\\b"), ("%_\\", "\\%\\_\\\\")])
def test_escaped_text_matches_only_itself(spark, raw, wanted):
    assert one(spark, raw, text.escape_like) == wanted
    rows = spark.createDataFrame([(raw,), ("axb",), ("a",)], "v string")
    assert [r.v for r in rows.where(F.like("v", F.lit(wanted), F.lit("\\"))).collect()] == [raw]


@pytest.mark.parametrize("raw, wanted", [
    ("5", 5), ("+5", 5), ("-4", -4), (" 7 ", 7), ("5.7", None), ("5L", None), ("", None), ("+", None), ("x", None),
    ("9223372036854775807", 2 ** 63 - 1), ("9223372036854775808", None), ("-9223372036854775808", -(2 ** 63)),
    ("٥", None), ("1 2", None), ("1\n", 1),
])
def test_parse_long(spark, raw, wanted):
    assert one(spark, raw, text.parse_long) == wanted


@pytest.mark.parametrize("raw, wanted", [
    ('"a ""x"", b"', 'a "x", b'), ('""', ""), ('"', '"'), ("plain", "plain"), ('"  pad  "', "  pad  "), ('"a', '"a'),
])
def test_unquote(spark, raw, wanted):
    assert one(spark, raw, text.unquote) == wanted


def test_utf16_length_counts_surrogates(spark):
    assert one(spark, "a\U0001f600", text.utf16_length) == 3


@pytest.mark.parametrize("query, wanted", [
    (None, "query: must not be blank"), ("", "query: must not be blank"), ("\t\t", "query: must not be blank"),
    ("q" * 512, None), ("q" * 513, "query: length must be at most 512"),
    ("\U0001f600" * 257, "query: length must be at most 512"),
    (" " * 513, "query: must not be blank; query: length must be at most 512"),
])
def test_query_error(spark, query, wanted):
    assert one(spark, query, text.query_error) == wanted


def test_modes(spark):
    rows = spark.createDataFrame([("recency",), ("RECENCY",), ("popularity",), ("Popularity",), ("x",), (None,)], "m string")
    got = [tuple(r) for r in rows.select(text.suggest_mode(F.col("m")), text.trending_mode(F.col("m"))).collect()]
    r, p = "RECENCY", "POPULARITY"
    assert got == [(r, r), (r, r), (p, p), (p, p), (p, r), (p, r)]


def test_prefixes_of_empty_and_long_text(spark):
    rows = spark.createDataFrame([("",), ("abc",), ("\U0001f600b",)], "v string")
    got = [r[0] for r in rows.select(text.prefixes(F.col("v"), 2)).collect()]
    assert got == [[], ["a", "ab"], ["\U0001f600", "\U0001f600b"]]


def test_list_round_trip(spark):
    rows = spark.createDataFrame([([("a \"q\"", 3), ("b", -1)],)], f"v {text.LIST_TYPE}")
    back = rows.select(text.list_from_json(text.list_to_json(F.col("v"))).alias("b"), "v").first()
    assert back.b == back.v


def test_ring_position_is_signed_big_endian(spark):
    keys = [f"key-{i}" for i in range(200)] + ["", "é\U0001f600"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.ring_position(F.col("k")))
    for key, got in rows.collect():
        assert got == int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big", signed=True)
    assert one(spark, "suggest:ip", hashing.ring_position) == -3175120986863060333


def test_hashed_numbers_stay_in_range_and_repeat(spark):
    drawn = spark.range(5000).select(hashing.hashed_below(50, "seed", F.col("id")).alias("n"))
    first, again = [r.n for r in drawn.collect()], [r.n for r in drawn.collect()]
    assert first == again and set(first) == set(range(50))


@pytest.mark.parametrize("value, wanted", [(0.00005, 0.0001), (1.23445, 1.2345), (-0.00005, 0.0), (2.0, 2.0)])
def test_half_up(spark, value, wanted):
    assert one(spark, value, scoring.half_up, "double") == pytest.approx(wanted, abs=1e-12)
