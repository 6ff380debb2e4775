import datetime as dt

import pytest
from pyspark.sql import functions as F

from keystride.operators import fold
from keystride.sources.polls import EventLog
from keystride.streaming import jobs

START = dt.datetime(2024, 1, 1)


def events(spark, n, first=0):
    rows = [(first + i, START + dt.timedelta(seconds=(first + i) // 3), f"q{i % 7}", None) for i in range(n)]
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, q string, d string")
    return frame.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3)


def run(stream, checkpoint, sizes, failing=None):
    """Drain the log; what each batch held goes to ``sizes``."""
    def per_batch(batch, batch_id):
        ids = [r.position for r in batch.select("position").collect()]
        if failing is not None and batch_id == failing:
            raise RuntimeError("lost")
        sizes.append((batch_id, min(ids), len(ids)))

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(per_batch).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@pytest.fixture
def log(spark, tmp_path):
    made = EventLog(spark, str(tmp_path / "log"))
    assert made.append(events(spark, 700), 0) and made.append(events(spark, 30, 700), 1)
    return made


def test_appends_are_numbered_once(spark, log):
    assert not log.append(events(spark, 700), 0)
    rows = log.read().orderBy("position").collect()
    assert [r.position for r in rows] == list(range(730)) == [r.event_id for r in rows]


def test_polls_are_bounded_and_go_on_after_a_restart(spark, log, tmp_path):
    sizes, checkpoint = [], str(tmp_path / "check")
    run(log.stream(), checkpoint, sizes)
    assert sizes == [(0, 0, 256), (1, 256, 256), (2, 512, 218)]
    log.append(events(spark, 300, 730), 2)
    run(log.stream(), checkpoint, sizes)
    assert sizes[3:] == [(3, 730, 256), (4, 986, 44)]


def test_a_backlog_is_read_in_batches_of_several_polls(spark, log, tmp_path):
    sizes, checkpoint = [], str(tmp_path / "check")
    run(log.stream(max_events=50, max_polls=6), checkpoint, sizes)
    assert sizes == [(0, 0, 300), (1, 300, 300), (2, 600, 100), (3, 700, 30)]
    log.append(events(spark, 120, 730), 2)
    run(log.stream(max_events=50, max_polls=6), checkpoint, sizes)
    assert sizes[4:] == [(4, 730, 100), (5, 830, 20)]


def test_a_lost_batch_is_read_again_with_the_same_bounds(spark, log, tmp_path):
    sizes, checkpoint = [], str(tmp_path / "check")
    with pytest.raises(Exception, match="lost"):
        run(log.stream(), checkpoint, sizes, failing=1)
    log.append(events(spark, 5, 730), 2)
    # Other bounds now: the planned batch keeps its own.
    run(log.stream(max_events=400), checkpoint, sizes)
    assert sizes == [(0, 0, 256), (1, 256, 256), (2, 512, 223)]


def test_few_events_wait_for_more_or_for_time(spark, log, tmp_path):
    sizes = []
    query = log.stream(max_events=500, min_events=500, max_wait=4).writeStream.option(
        "checkpointLocation", str(tmp_path / "check")).foreachBatch(
        lambda batch, n: sizes.append(batch.count())).trigger(processingTime="0 seconds").start()
    try:
        query.awaitTermination(3)
        assert sizes in ([], [500])
        query.awaitTermination(12)
    finally:
        query.stop()
    assert sizes == [500, 230]


def test_flushes_of_polls_equal_the_batch_fold(spark, log, tmp_path):
    store = jobs.FlushStore(spark, str(tmp_path / "flushes"))
    for checkpoint in ("check", "lost"):  # the second run repeats every batch
        jobs.maintain_flushes(log.stream(), store, str(tmp_path / checkpoint), flush_events=512, drain=True)
    got = store.read().select("flush", "query_norm", "delta", "display").collect()
    whole = fold.usable_events(log.read()).withColumn("flush", F.floor(F.col("position") / 512))
    want = fold.fold(whole, ["flush"]).select("flush", "query_norm", "delta", "display").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.flush for r in got} == {0, 1}
