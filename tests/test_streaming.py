import datetime as dt

import pytest
from pyspark.sql import functions as F

from keystride.operators import expiry, fold, merge, prefix, trending, upkeep
from keystride.sources import events as log
from keystride.sources.batches import BatchTable
from keystride.sources.dictionary import DictionaryStore
from keystride.sources.ranges import DictionaryRanges
from keystride.sources.scores import ScoreStore
from keystride.streaming import jobs

START = dt.datetime(2024, 1, 1)
ROWS = [(i, i * 600 + (i % 7), f"q{i % 9}" if i % 50 else None, f"Q{i % 9}" if i % 3 else None) for i in range(400)]


@pytest.fixture
def event_files(spark, tmp_path):
    """The event log as several files, in time order."""
    path = str(tmp_path / "log")
    frame = spark.createDataFrame(
        [(i, START + dt.timedelta(seconds=s), q, d) for i, s, q, d in ROWS], "event_id long, t timestamp_ntz, q string, d string",
    ).select("event_id", F.col("t").cast("timestamp").alias("ts"), "q", "d")
    for part in range(4):
        frame.where(F.floor(F.col("event_id") / 100) == part).coalesce(1).write.mode("append").parquet(path)
    return path, frame


def base(spark):
    return merge.as_dictionary(spark.createDataFrame([("Q1", 10), ("old", 3)], "query string, count long"),
                               F.lit("2023-01-01").cast("timestamp"))


def per_norm(df):
    return {r.query_norm: r.c for r in df.groupBy("query_norm").agg(F.sum("count").alias("c")).collect()}


def expected_counts(spark, frame):
    return per_norm(merge.upsert(base(spark), merge.deltas_as_rows(fold.fold(fold.usable_events(frame)))))


def test_counts_stream_equals_batch(spark, event_files, tmp_path):
    path, frame = event_files
    store = DictionaryStore(spark, str(tmp_path / "store"))
    assert store.is_empty() and store.load_if_empty(base(spark)) and not store.load_if_empty(base(spark))
    checkpoint = str(tmp_path / "check")
    stream = log.stream_events(spark, path, max_files=1)
    jobs.maintain_counts(stream, store, checkpoint, drain=True).awaitTermination()
    assert store.pending().select("batch_id").distinct().count() == 4
    assert per_norm(store.read()) == expected_counts(spark, frame)
    # A restart with nothing new changes nothing; compaction neither.
    jobs.maintain_counts(stream, store, checkpoint, drain=True).awaitTermination()
    assert store.compact() == 1 and store.pending().isEmpty()
    assert per_norm(store.read()) == expected_counts(spark, frame)
    # New events after the compaction.
    frame.where("event_id < 10").withColumn("q", F.lit("late")).coalesce(1).write.mode("append").parquet(path)
    jobs.maintain_counts(stream, store, checkpoint, drain=True).awaitTermination()
    assert per_norm(store.read()) == {**expected_counts(spark, frame), "late": 10}


def test_lists_stream_equals_lists_computed_afresh(spark, event_files, tmp_path):
    path, frame = event_files
    dictionary = DictionaryRanges(spark, str(tmp_path / "dictionary"), target_rows=5)
    dictionary.load(base(spark))
    lists = upkeep.PrefixLists(spark, str(tmp_path / "lists"), k=3, spare=1, target_rows=10)
    lists.build(dictionary)
    stream = log.stream_events(spark, path, max_files=2)
    for checkpoint in ("check", "check", "lost"):  # the last run repeats every batch
        jobs.maintain_lists(stream, dictionary, lists, str(tmp_path / checkpoint), drain=True).awaitTermination()
        assert per_norm(dictionary.read()) == expected_counts(spark, frame)
        fresh = prefix.all_prefix_top(dictionary.read(), 3)
        assert sorted(map(tuple, lists.lists().collect())) == sorted(map(tuple, fresh.collect()))


def test_repeated_batch_changes_nothing(spark, tmp_path):
    store = DictionaryStore(spark, str(tmp_path / "store"))
    store.load_if_empty(base(spark))
    for _ in range(2):
        store.commit(base(spark), 0)
    assert per_norm(store.read()) == {"q1": 20, "old": 6}


def test_uncommitted_delta_is_not_seen(spark, tmp_path):
    store = DictionaryStore(spark, str(tmp_path / "store"))
    store.load_if_empty(base(spark))
    base(spark).write.parquet(str(tmp_path / "store" / "deltas" / "data" / "batch_id=0" / "attempt=lost"))
    assert per_norm(store.read()) == {"q1": 10, "old": 3}
    # A base without its version row is not seen either.
    base(spark).withColumn("count", F.lit(99).cast("bigint")).write.parquet(str(
        tmp_path / "store" / "base" / "version=1" / "attempt=lost"))
    assert per_norm(store.read()) == {"q1": 10, "old": 3}


def test_failed_batch_is_replayed(spark, event_files, tmp_path):
    path, frame = event_files

    class Failing(BatchTable):
        left = 1

        def write(self, rows, batch_id):
            if batch_id == 2 and Failing.left:
                Failing.left -= 1
                rows.select(*self.schema.names).write.parquet(f"{self.root}/data/batch_id=2/attempt=lost")
                raise RuntimeError("lost before the commit")
            return super().write(rows, batch_id)

    store = DictionaryStore(spark, str(tmp_path / "store"))
    store.deltas = Failing(spark, store.deltas.root, store.deltas.schema)
    store.load_if_empty(base(spark))
    stream = log.stream_events(spark, path, max_files=1)
    with pytest.raises(Exception):
        jobs.maintain_counts(stream, store, str(tmp_path / "check"), drain=True).awaitTermination()
    assert store.pending().select("batch_id").distinct().count() == 2
    jobs.maintain_counts(stream, store, str(tmp_path / "check"), drain=True).awaitTermination()
    assert per_norm(store.read()) == expected_counts(spark, frame)


def test_scores_stream_equals_batch(spark, event_files, tmp_path):
    path, frame = event_files
    store = jobs.PartialStore(spark, str(tmp_path / "partials"))
    stream = log.stream_events(spark, path, max_files=1)
    jobs.maintain_scores(stream, store, str(tmp_path / "check"), drain=True).awaitTermination()
    at = START + dt.timedelta(days=4)
    got = {r.query_norm: r.score for r in trending.scores_from_partials(store.read(), at).collect()}
    wanted = {r.query_norm: r.score for r in trending.decayed_scores(fold.usable_events(frame), at).collect()}
    assert got == pytest.approx(wanted, rel=1e-9)


def test_late_events_miss_closed_windows_but_count(spark, event_files, tmp_path):
    path, frame = event_files
    store = jobs.PartialStore(spark, str(tmp_path / "partials"))
    counts = DictionaryStore(spark, str(tmp_path / "store"))
    stream = log.stream_events(spark, path, max_files=1)

    def run():
        jobs.maintain_scores(stream, store, str(tmp_path / "check-s"), drain=True).awaitTermination()
        jobs.maintain_counts(stream, counts, str(tmp_path / "check-c"), drain=True).awaitTermination()

    run()
    tardy = frame.where("event_id = 1").withColumns({"q": F.lit("tardy"), "d": F.lit("Tardy")})
    tardy.coalesce(1).write.mode("append").parquet(path)
    run()
    assert store.read().where("query_norm = 'tardy'").isEmpty()
    assert per_norm(counts.read())["tardy"] == 1


def test_entries_stream_equals_batch(spark, event_files, tmp_path):
    path, frame = event_files
    ttl = 3 * 3600 * 1000
    store = jobs.EntryStore(spark, str(tmp_path / "entries"))
    asked = log.stream_events(spark, path, max_files=1).select(F.col("event_id").alias("req_id"), "ts", F.coalesce("q", F.lit("-")).alias("key"))
    jobs.track_entries(asked, store, str(tmp_path / "check"), "key", ttl, drain=True).awaitTermination()
    whole = frame.select(F.col("event_id").alias("req_id"), "ts", F.coalesce("q", F.lit("-")).alias("key"))
    got = {(r.key, r.filled_ms) for r in store.filled("key string, filled_ms bigint, req_id bigint").collect()}
    assert got == {(r.key, r.filled_ms) for r in expiry.refills(whole, "key", ttl).collect()}


def test_forgotten_entries_leave_the_table(spark, event_files, tmp_path):
    path, frame = event_files
    ttl = 3600 * 1000
    store = jobs.EntryStore(spark, str(tmp_path / "entries"))
    asked = log.stream_events(spark, path, max_files=1).select(F.col("event_id").alias("req_id"), "ts", F.col("event_id").cast("string").alias("key"))
    jobs.track_entries(asked, store, str(tmp_path / "check"), "key", ttl, drain=True, lateness_ms=0).awaitTermination()
    assert store.filled("key string, filled_ms bigint, req_id bigint").count() == 400
    assert store.alive_before(4, "key string, ends_ms bigint").count() <= 8


def test_batches_count_once_and_old_ones_can_go(spark, tmp_path):
    root = str(tmp_path / "t")
    store = BatchTable(spark, root, "v int")
    one = spark.createDataFrame([(1,)], "v int")
    assert store.read().isEmpty() and store.last() is None
    assert [store.write(one, b) for b in (0, 1, 1)] == [True, True, False]
    assert sorted(r.batch_id for r in store.read().collect()) == [0, 1] and store.read(after=0).count() == 1
    store.vacuum(1)
    assert [r.batch_id for r in store.read().collect()] == [1] and not store.write(one, 0)


def test_partials_survive_compaction_and_vacuum(spark, tmp_path):
    store = jobs.PartialStore(spark, str(tmp_path / "p"))
    rows = lambda v: spark.createDataFrame([("a", START, v), (f"q{v}", START, 1.0)], store.SCHEMA)
    want = {}
    for b in range(4):
        store.write(rows(float(b)), b)
        want |= {"a": float(b), f"q{float(b)}": 1.0}
        if b % 2:
            store.compact()
            store.vacuum()
        assert {r.query_norm: r.partial for r in store.read().collect()} == want


def test_scores_of_a_repeated_batch_count_once(spark, event_files, tmp_path):
    _, frame = event_files
    used = fold.usable_events(frame)
    store = ScoreStore(spark, str(tmp_path / "s"))
    at = START + dt.timedelta(days=4)
    for b in (0, 1, 1, 0):
        store.add(used.where(F.col("event_id") % 2 == b), at, batch_id=b)
    store.vacuum()
    got = {r.query_norm: r.score for r in store.read().collect()}
    assert got == pytest.approx({r.query_norm: r.score for r in trending.decayed_scores(used, at).collect()})


def test_old_versions_can_go(spark, tmp_path):
    store = DictionaryStore(spark, str(tmp_path / "store"))
    store.load_if_empty(base(spark))
    for b in range(3):
        store.commit(base(spark), b)
        store.compact()
    store.vacuum(3)
    store.commit(base(spark), 3)
    assert per_norm(store.read()) == {"q1": 50, "old": 15}
