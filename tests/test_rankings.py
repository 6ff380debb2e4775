import datetime as dt

import pytest
from pyspark.sql import functions as F

from keystride.functions import sql
from keystride.operators import fold, prefix, replay, reports, trending
from keystride.sources import sketches
from keystride.streaming import rankings, sessions

START = dt.datetime(2024, 1, 1)
# Arrival order by file; some events of the first hours come in the last files.
FILES = [
    [(i, 600 * i, f"q{i % 5}") for i in range(40)],
    [(i, 600 * i, f"q{i % 3}") for i in range(40, 80)] + [(200, 23500, "just late enough")],
    [(300, 60, "q1"), (301, 7000, "late"), (302, 47000, "q2")] + [(i, 600 * i, "q4") for i in range(80, 100)],
    [(400, 3000, "late"), (401, 61000, None)],
]


def events(spark, rows):
    frame = spark.createDataFrame([(i, START + dt.timedelta(seconds=s), q) for i, s, q in rows], "event_id bigint, t timestamp_ntz, q string")
    return frame.select("event_id", F.col("t").cast("timestamp").alias("ts"), "q", F.lit(None).cast("string").alias("d"))


@pytest.fixture
def log(spark, tmp_path):
    for part, rows in enumerate(FILES):
        events(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/log/part={part}")
    schema = events(spark, FILES[0]).schema
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/part=*")


def everything(spark):
    return fold.usable_events(events(spark, [r for rows in FILES for r in rows]))


def close(got, want):
    a, b = ({r[0]: r[1] for r in f.collect()} for f in (got, want))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 * max(1, b[k]) for k in a)


def test_late_events_are_kept_and_filled_in(spark, log, tmp_path):
    store = rankings.WindowSums(spark, str(tmp_path / "sums"))
    for checkpoint in ("check", "lost"):  # the second run repeats every batch
        rankings.maintain_sums(log(), store, str(tmp_path / checkpoint), "1 hour", 600, 3600.0, drain=True).awaitTermination()
    # Watermarks: 39 * 600 - 600 for the second file, 79 * 600 - 600 for the third, 99 * 600 - 600 for the last.
    assert sorted(r.event_id for r in store.late.read().collect()) == [300, 301, 400]
    batch = trending.score_partials(everything(spark), "1 hour", 3600.0)
    on_time = trending.score_partials(everything(spark).where("event_id not in (300, 301, 400)"), "1 hour", 3600.0)
    keyed = lambda f: f.select(F.concat_ws("@", "query_norm", "window_end"), "partial")
    close(keyed(store.read()), keyed(on_time))
    assert store.backfill("1 hour", 3600.0) and not store.backfill("1 hour", 3600.0)
    store.compact()
    close(keyed(store.read()), keyed(batch))


def test_snapshots_on_a_stream_equal_those_of_the_whole_log(spark, log, tmp_path):
    words = spark.createDataFrame([(f"Q{i}", f"q{i}", 10 * i + 1) for i in range(6)], "query string, query_norm string, count bigint")
    store = rankings.SnapshotStore(spark, str(tmp_path / "snapshots"))
    span = ("2023-12-31 22:00:00", "2024-01-01 20:00:00")
    rankings.maintain_snapshots(log(), words, store, str(tmp_path / "check"), span[0], 3600, size=3, half_life=7200.0, drain=True, last=span[1])
    got = store.read().select("as_of", "rank", "query", "count", F.round("blended", 6), "source")
    partials = trending.score_partials(everything(spark), "1 hour", 7200.0)
    want = trending.trending_snapshots(partials, words, *span, 3600, size=3, half_life=7200.0).select(
        "as_of", "rank", "query", "count", F.round("blended", 6), "source")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.select("as_of").distinct().count() == 23


def requests(spark, log):
    return log.select(F.col("event_id").alias("req_id"), "ts", (F.col("event_id") % 4).alias("user_id"),
                      F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("q")).alias("prefix"),
                      (F.col("event_id") % 5 * 600_000.0).alias("took_ms"))


def in_order(spark, tmp_path, closing=()):
    rows = [(i, 600 * i + 37 * (i % 11 == 0) - 300 * (i % 13 == 0), f"q{i}") for i in range(1, 120)]
    parts = [rows[n:n + 40] for n in range(0, 120, 40)] + list(closing)
    for part, some in enumerate(parts):
        events(spark, some).coalesce(1).write.parquet(f"{tmp_path}/order/part={part}")
    schema = events(spark, rows).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/order/part=*"), events(spark, rows)


@pytest.mark.parametrize("delay", [2400.0, 2437.0])
def test_debounce_on_a_stream(spark, tmp_path, delay):
    stream, whole = in_order(spark, tmp_path, [[(-1, 10**6, "end")], [(-2, 2 * 10**6, "end")]])
    kept = sessions.debounce_stream(requests(spark, stream), delay, "10 minutes").where("req_id > 0")
    kept.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).format("parquet").start(
        str(tmp_path / "kept")).awaitTermination()
    got = spark.read.schema(kept.schema).parquet(str(tmp_path / "kept")).select("req_id", "prefix")
    want = replay.debounce(requests(spark, whole), delay).select("req_id", "prefix")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 0 < want.count() < 119


@pytest.mark.parametrize("max_group_rows", [5, 10**6])
def test_superseded_on_a_stream(spark, tmp_path, max_group_rows):
    stream, whole = in_order(spark, tmp_path)
    store = sessions.HeldRequests(spark, str(tmp_path / "held"))
    for checkpoint in ("check", "lost"):
        sessions.maintain_superseded(requests(spark, stream), store, str(tmp_path / checkpoint), 900.0, drain=True,
                                     max_group_rows=max_group_rows).awaitTermination()
    got = store.read(ended=True).select("req_id", "superseded")
    want = replay.mark_superseded(requests(spark, whole)).select("req_id", "superseded")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert store.held.read(after=1).count() < 20  # what is held does not grow with the log
    store.vacuum()
    assert store.read(ended=True).count() == 119


def test_sketches_merge_over_any_span(spark, tmp_path):
    log = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("took_ms"), (F.col("id") % 4).alias("n"),
                                     F.when(F.col("id") % 3 == 0, "cold").otherwise("warm").alias("phase"))
    store = sketches.LatencySketches(spark, str(tmp_path / "kll"), ["phase"])
    distinct = sketches.DistinctSketches(spark, str(tmp_path / "hll"))
    for n in range(4):
        part = log.where(F.col("n") == n)
        assert store.add(part, n) and not store.add(part, n)
        distinct.add(part.select((F.col("took_ms") % 5000).cast("string").alias("query_norm")), n)
    for after, through in ((None, None), (0, 2)):
        span = log.where((F.col("n") > (-1 if after is None else after)) & (F.col("n") <= (3 if through is None else through)))
        exact = {r.phase: r for r in reports.latency(span.withColumn("req_id", F.col("took_ms")), by=["phase"]).collect()}
        for r in store.quantiles(after, through).collect():
            values = sorted(x.took_ms for x in span.where(F.col("phase") == r.phase).collect())
            assert r.n == len(values) and abs(r.mean - exact[r.phase]["mean"]) < 1e-6
            for q in reports.QUANTILES:
                rank = sum(v <= r[f"p{round(q * 100)}"] for v in values) / len(values)
                assert abs(rank - q) <= sketches.rank_bound(200)
        row = distinct.count(after, through).first()
        assert row.n == span.count() and abs(row.n_distinct - 5000) <= 5000 * sketches.distinct_bound()
    assert distinct.count(99).first().n_distinct == 0 and store.quantiles(99).count() == 0


@pytest.fixture
def searched(spark):
    words = spark.createDataFrame([("Iphone", "iphone", 50), ("iphone", "iphone", 7), ("ipad", "ipad", 40), ("IPOD", "ipod", 3), ("i%", "i%", 1)],
                                  "query string, query_norm string, count bigint")
    scores = spark.createDataFrame([("ipod", 9.0), ("ipad", 1.0), ("gone", 4.0)], "query_norm string, score double")
    return words, scores


def test_sql_functions_equal_the_python_ones(spark, searched):
    words, scores = searched
    sql.register(spark, words, scores)
    for p in ("ip", " IP", "i%", "zz", ""):
        for mode in ("popularity", "Recency", "other"):
            got = spark.sql(f"SELECT rank, query, count, source FROM suggest('{p}', '{mode}', 2)")
            want = prefix.suggest(words, scores, p, mode, k=2).select("rank", "query", "count", "source")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (p, mode)
    assert spark.sql("SELECT * FROM suggest('ip')").count() == 4
    for mode in ("recency", "popularity", "other"):
        got = spark.sql(f"SELECT rank, query, count, mode, source FROM trending('{mode}', 3)")
        want = trending.trending(words, scores, mode, 3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), mode


def test_sql_functions_are_plans_that_join_with_others(spark, searched):
    words, scores = searched
    sql.register(spark, words, scores.limit(0))
    assert {r.source for r in spark.sql("SELECT * FROM trending()").collect()} == {"FALLBACK_POPULARITY"}
    asked = spark.sql("SELECT s.query, w.count FROM suggest('ip', k => 1) s JOIN keystride_dictionary w ON w.query = s.query")
    assert [tuple(r) for r in asked.collect()] == [("Iphone", 50)]
    assert "Python" not in asked._jdf.queryExecution().toString()
