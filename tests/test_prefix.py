import random

import pytest
from pyspark.sql import functions as F

from keystride.operators import prefix
from keystride.sources.dictionary import DictionaryStore

ROWS = [
    ("iPhone", 50), ("iphone", 90), ("iphone 15", 90), ("ipad", 70), ("a%b", 5), ("a_b", 4), ("a\\b", 3), ("axb", 9),
    ("java", 10), ("Java", 12), ("neg", -4), ("İx", 1),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "query string, count long").withColumn("query_norm", F.lower("query"))


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([("iphone", 2.0), ("java", 8.0), ("ghost", 99.0)], "query_norm string, score double")


def listed(df, *cols):
    return [tuple(r) for r in df.orderBy("rank").select(*cols).collect()]


def test_prefix_top_breaks_ties_by_text(table):
    assert listed(prefix.prefix_top(table, " IP", 3), "query", "count") == [("iphone", 90), ("iphone 15", 90), ("ipad", 70)]


@pytest.mark.parametrize("asked, found", [("a%", ["a%b"]), ("a_", ["a_b"]), ("a\\", ["a\\b"])])
def test_wildcards_are_literal(table, asked, found):
    assert [q for (q,) in listed(prefix.prefix_top(table, asked), "query")] == found


@pytest.mark.parametrize("asked", ["", "  \t", None])
def test_blank_prefix_finds_nothing(table, asked):
    assert prefix.prefix_top(table, asked).isEmpty()


def test_norm_top_merges_variants(table):
    assert listed(prefix.norm_top(table, "iph"), "query", "count") == [("iphone", 90), ("iphone 15", 90)]
    assert listed(prefix.norm_top(table, "iph", how="sum"), "query", "count") == [("iphone", 140), ("iphone 15", 90)]
    with pytest.raises(ValueError):
        prefix.norm_top(table, "i", how="last")


def test_all_prefixes_agree_with_single_ones(table):
    everything = prefix.all_prefix_top(table, 2, 12)
    for asked in {q.lower()[:n].strip() for q, _ in ROWS for n in range(1, 13)}:
        both = listed(everything.where(F.col("prefix") == asked), "query", "count")
        assert both == listed(prefix.prefix_top(table, asked, 2), "query", "count"), asked


def test_recency_lifts_recent_queries(table, scores):
    got = listed(prefix.prefix_recency(table, scores, "j"), "query", "count", "score", "blended")
    assert got == [("Java", 12, 8.0, 1.0), ("java", 10, 8.0, pytest.approx(0.5 * 10 / 12 + 0.5))]


def test_recency_without_any_score_is_popularity(table, scores):
    got = listed(prefix.prefix_recency(table, scores.limit(0), "i"), "query")
    assert got == listed(prefix.prefix_top(table, "i"), "query")


def test_counts_below_one_do_not_break_the_blend(table, scores):
    assert listed(prefix.prefix_recency(table, scores, "neg"), "query", "blended") == [("neg", -2.0)]


def test_pool_hides_recent_but_rare_queries(spark):
    rows = [(f"q{i:03}", 1000 - i) for i in range(60)]
    table = spark.createDataFrame(rows, "query string, count long").withColumn("query_norm", F.col("query"))
    hot = spark.createDataFrame([("q059", 5.0)], "query_norm string, score double")
    for top in (prefix.prefix_recency, lambda *a, **k: prefix.all_prefix_recency(a[0], a[1], **k).where("prefix = 'q'")):
        assert ("q059",) not in listed(top(table, hot, "q"), "query")
        assert listed(top(table, hot, "q", pool=None), "query")[0] == ("q059",)


@pytest.mark.parametrize("pool", [3, None])
def test_all_prefix_recency_agrees_with_single_prefixes(table, scores, pool):
    everything = prefix.all_prefix_recency(table, scores, 2, 0.3, pool, 12).cache()
    for asked in ("i", "ip", "iphone 1", "a", "j", "neg"):
        one = prefix.prefix_recency(table, scores, asked, 2, 0.3, pool)
        assert listed(everything.where(F.col("prefix") == asked), "query", "blended") == listed(one, "query", "blended")


def test_hot_prefixes_keep_their_rows_in_place(table, scores, values):
    plain = prefix.all_prefix_recency(table, scores, 2, pool=None)
    assert values(prefix.all_prefix_recency(table, scores, 2, pool=None, max_group_rows=2)) == values(plain)


def test_wanted_prefixes_only(table, scores, spark, values):
    wanted = spark.createDataFrame([("ip",), ("java",), ("zz",)], "prefix string")
    everything = prefix.all_prefix_top(table, 2, 12)
    cut = everything.join(wanted, "prefix", "left_semi")
    assert values(prefix.all_prefix_top(table, 2, wanted=wanted)) == values(cut)
    lengths, before, after = prefix.only_for(wanted, max_broadcast=1)
    assert lengths == [2, 4] and values(after(everything)) == values(cut) and before(everything) is everything
    recent = prefix.all_prefix_recency(table, scores, 2, wanted=wanted)
    assert {r.prefix for r in recent.collect()} == {"ip", "java"}


def test_layout_changes_nothing(spark, values):
    rng = random.Random(5)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))), rng.randrange(9)) for _ in range(500)]
    table = spark.createDataFrame(rows, "query string, count long").groupBy("query").agg(F.max("count").alias("count"))
    table = table.withColumn("query_norm", F.col("query"))
    assert values(prefix.all_prefix_top(prefix.sort_for_prefixes(table), 3)) == values(prefix.all_prefix_top(table, 3))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_reaches_the_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "d"))
    plan = plan_of(prefix.prefix_top(spark.read.parquet(str(tmp_path / "d")), "ip"))
    assert "StringStartsWith(query_norm,ip)" in plan and "TakeOrderedAndProject" in plan


def test_all_prefix_plans_limit_groups_before_the_shuffle(table, scores):
    for df in (prefix.all_prefix_top(table), prefix.all_prefix_recency(table, scores)):
        plan = plan_of(df)
        partial = plan.index("row_number(), 50, Partial" if "50, Partial" in plan else "row_number(), 10, Partial")
        assert plan.rindex("Exchange hashpartitioning(prefix") < partial
        assert plan.count("Exchange hashpartitioning(prefix") == 1
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_long_prefixes_are_answered(spark, scores):
    word = "a" * 40 + "b"
    table = spark.createDataFrame([(word, 3), ("a" * 30, 9)], "query string, count long").withColumn("query_norm", F.lower("query"))
    got = {r.prefix: r.query for r in prefix.all_prefix_top(table).where("rank = 1").collect()}
    assert len(got) == 41 and got[word] == word and got["a" * 31] == word and got["a" * 30] == "a" * 30
    assert {r.prefix for r in prefix.all_prefix_recency(table, scores).collect()} == set(got)


def test_group_limit_is_planned_for_large_k(table, scores):
    for frame in (prefix.all_prefix_top(table, 2000), prefix.all_prefix_recency(table, scores, 500)):
        assert "WindowGroupLimit" in frame._jdf.queryExecution().executedPlan().toString()


def test_answer_names_its_kind(table, scores):
    assert prefix.suggest(table, scores, " IPa", "Recency").first().asDict() == {
        "prefix": "ipa", "mode": "RECENCY", "source": "DB+RECENCY", "rank": 1, "query": "ipad", "count": 70}
    assert prefix.suggest(table, scores, "ipa", "x", source="trie").first().source == "TRIE"
    assert prefix.suggest(table, scores, None).isEmpty() and prefix.suggest(table, scores, " \t").isEmpty()


def test_a_prefix_still_reaches_the_scan(table, tmp_path, spark):
    table.write.parquet(str(tmp_path / "d"))
    plan = prefix.prefix_top(spark.read.parquet(str(tmp_path / "d")), " IP")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(query_norm,ip)" in plan
