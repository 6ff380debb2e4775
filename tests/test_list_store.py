from pyspark.sql import functions as F

from keystride.operators import serving
from keystride.sources.lists import ListStore

def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def lists(spark, n, value="[]"):
    ends = (at() + F.expr("INTERVAL 1 HOUR")).alias("expires_at")
    return spark.range(n).select(F.concat(F.lit("suggest:k"), "id").alias("cache_key"), F.lit("node-0").alias("node"), F.lit(value).alias("value"), ends)


def test_the_newest_lists_are_read_whoever_wrote_them(spark, tmp_path):
    store = ListStore(spark, str(tmp_path), buckets=4)
    assert store.read().count() == 0
    store.write(lists(spark, 50))
    store.write(lists(spark, 20, "[1]"))
    assert [r.value for r in store.read().select("value").distinct().collect()] == ["[1]"] and store.read().count() == 20
    # Another session knows the table by its files alone.
    attempt = store._versions().orderBy(F.desc("version")).first().attempt
    spark.sql(f"DROP TABLE keystride_lists_{attempt}")
    assert ListStore(spark, str(tmp_path)).read().count() == 20
    store.vacuum()
    assert store.read().count() == 20


def exchanges_on_the_store(plan):
    """Exchanges above the scan of the stored lists in the tree that Spark prints."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" +-:"))
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            found += ["Exchange"] if "Exchange" in line else []
    return found


def test_answering_joins_without_shuffling_the_store(spark, tmp_path):
    store = ListStore(spark, str(tmp_path), buckets=4)
    store.write(lists(spark, 5000))
    asked = spark.range(3000).select(F.concat(F.lit("suggest:k"), F.col("id") * 2).alias("cache_key"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = store.read().where(F.col("expires_at") > at()).join(asked.distinct(), "cache_key", "left_semi")
        plan = met._jdf.queryExecution().simpleString()
        assert met.count() == 2500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert exchanges_on_the_store(plan) == [] and "Exchange" in plan


def test_answers_from_the_store(spark, tmp_path):
    words = spark.createDataFrame([("Ab", "ab", 5), ("ac", "ac", 7)], "query string, query_norm string, count bigint")
    scores = spark.createDataFrame([], "query_norm string, score double, level double")
    store = ListStore(spark, str(tmp_path), buckets=2)
    store.write(spark.createDataFrame([("suggest:a", "n", "[stored]")], "cache_key string, node string, value string").withColumn(
        "expires_at", at() + F.expr("INTERVAL 1 HOUR")))
    asked = spark.createDataFrame([(1, "a", "x"), (2, "ab", "x"), (3, "", "x")], "req_id int, q string, mode string")
    got = serving.answer(asked, store.read(), words, scores, at()).select("req_id", "source", "value")
    assert sorted(map(tuple, got.collect())) == [(1, "MATERIALIZED", "[stored]"), (2, "COMPUTED", '[{"query":"Ab","count":5}]'), (3, "EMPTY", "[]")]
