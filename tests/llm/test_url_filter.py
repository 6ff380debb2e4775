import random

from pyspark.sql import functions as F

from keystride.llm import url_filter
from keystride.llm.queries import BLOCKED_DOMAINS, ORACLE, URL_RULES

PAGES = "page_id bigint, url string, html string"
ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http:///en/"), (6, "HTTP://WWW.Example.COM/en/x"),
    (7, "http://example.com"), (8, "http://example.com?x=/en/"), (9, "http://example.com#/en/"), (10, "http://notexample.com/en/"),
    (11, "http://a.b.example.com/en/"), (12, "http://example.com/en"), (13, "http://x.net/es/"), (14, "http://net/fr/"),
    (15, "http://sub.spam-farm.example.org/q"), (16, "ftp://xspam-farm.example.org/"), (17, "a://b://c.net/es/"),
    (18, "http://com./"), (19, "http://..com/"), (20, "http://example.com/en/" + "y" * 30000), (20, "http://example.com/en/"),
    (None, "http://free-bets.example.net/fr/"), (22, "http://É.net/fr/\nx"), (23, "http://free-bets.example.net/xx/"),
]


def judged(spark, frame, rules=URL_RULES, domains=BLOCKED_DOMAINS):
    listed = spark.createDataFrame([(d,) for d in domains], "domain string")
    return url_filter.judge(frame, rules, listed)


def test_odd_urls_equal_sql(spark, answers, plain):
    frame = spark.createDataFrame([(i, u, "h") for i, u in ODD], PAGES)
    assert plain(judged(spark, frame)) == answers(ORACLE["op4_url_filter"], pages=frame)


def test_no_rules_no_domains_no_rows(spark):
    frame = spark.createDataFrame([(i, u, "h") for i, u in ODD], PAGES)
    got = url_filter.judge(frame, (), None).select("rule", "verdict", "domain").distinct().collect()
    assert [tuple(r) for r in got] == [(None, "allow", None)]
    assert judged(spark, frame.limit(0)).count() == 0


def test_extra_columns_may_clash(spark, plain):
    frame = spark.createDataFrame([(1, "http://x.com/", "h")], PAGES)
    wide = frame.withColumns({c: F.lit("?") for c in ("host", "path", "rule", "key", "keys", "verdict")})
    assert plain(judged(spark, wide)) == plain(judged(spark, frame))


def test_no_python_and_no_join_on_the_way_of_urls(spark):
    frame = spark.createDataFrame([(1, "http://x.com/", "h")], PAGES)
    plan = judged(spark, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def told(cascade, frame):
    return {r.key for r in frame.where(cascade.listed(F.col("key"))).collect()}


def test_a_cascade_is_exact_for_its_universe(spark):
    draw = random.Random(3)
    universe = [f"k{i}" for i in range(4000)]
    for n in (0, 1, 50, 2000, 4000):
        listed = set(draw.sample(universe, n))
        frame = keys(spark, universe)
        cascade = url_filter.build_cascade(keys(spark, listed | {"elsewhere"}), frame)
        assert told(cascade, frame) == listed and cascade.rest is None


def test_full_filters_fall_back_to_a_join(spark, monkeypatch, plain):
    frame = spark.createDataFrame([(i, f"http://h{i}.example.net/fr/{i}", "h") for i in range(300)] + [(900, None, "h")], PAGES)
    domains = [f"h{i}.example.net" for i in range(0, 300, 3)]
    rules = URL_RULES[:3]
    want = plain(judged(spark, frame, rules, domains))
    assert sum(dict(r)["verdict"] == "block" for r in want) == 100
    monkeypatch.setattr(url_filter, "MAX_BITS", 64)
    assert plain(judged(spark, frame, rules, domains)) == want
