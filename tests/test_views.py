from pyspark.sql import functions as F

from keystride.functions import text
from keystride.plans.queries import scores
from keystride.sources.views import TestViews


def views(spark, root):
    words = [f"w{i}" for i in range(120) for _ in range(i % 7 + 1)] + ["x" * 513, "é" * 400, "\U0001f600" * 257, "", "w1"]
    spark.createDataFrame([(1, " ".join(words)), (2, "w1\t\nw2"), (3, None), (None, "w5")], "doc_id long, text string").write.parquet(
        f"{root}/documents.parquet")
    rows = [(i, i % 3, f'{{"k": {i % 100}}}') for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, props string")
    events.select("*", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value")).write.parquet(
        f"{root}/events.parquet")
    return TestViews(spark, str(root))


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_events_do_not_count_the_words_again(spark, tmp_path):
    v = views(spark, tmp_path)
    assert v.raw_event.count() == 200
    for frame in (v.raw_event, scores(v), v.kept_query):
        assert "Generate" not in plan(frame) and "split(" not in plan(frame)
    assert sorted(map(tuple, v.kept_query.collect())) == sorted(map(tuple, v.search_query.collect()))


def test_overlong_words_are_told_by_their_units(spark, tmp_path):
    v = views(spark, tmp_path)
    long = [r.w for r in v.all_words.where(v.overlong).collect()]
    assert sorted(long) == sorted(r.w for r in v.all_words.where(text.utf16_length(F.col("w")) > 512).collect())
    assert sorted(map(len, long)) == [257, 513] and v.doc_word.where("w = '" + "é" * 400 + "'").count() == 1
