import datetime as dt

import pytest
from pyspark.sql import functions as F

from keystride.operators import fold, merge
from keystride.sources import events as log

START = dt.datetime(2024, 1, 1)


def clean(spark, rows):
    """Rows of (id, second, norm, display)."""
    return spark.createDataFrame(
        [(i, START + dt.timedelta(seconds=s), n, d) for i, s, n, d in rows],
        "event_id long, t timestamp_ntz, query_norm string, display string",
    ).withColumn("ts", F.col("t").cast("timestamp")).drop("t")


@pytest.mark.parametrize("n, chunks", [(499, [499]), (500, [500]), (501, [500, 1])])
@pytest.mark.parametrize("bound", [10 ** 6, 0])
def test_flush_closes_at_the_threshold(spark, n, chunks, bound):
    rows = clean(spark, [(i, i // 200, "q", "Q") for i in range(n)])
    flushed = fold.fold(fold.assign_flushes(rows, max_group_rows=bound), fold.FLUSH).orderBy(*fold.FLUSH)
    assert [r.delta for r in flushed.collect()] == chunks


def test_flush_closes_with_its_window(spark):
    rows = clean(spark, [(1, 0, "q", "Q"), (2, 4, "q", "Q"), (3, 5, "q", "Q"), (4, 11, "q", "Q")])
    flushed = fold.fold(fold.assign_flushes(rows), fold.FLUSH).orderBy("flush_window").collect()
    assert [r.delta for r in flushed] == [2, 1, 1]


def test_first_display_wins(spark):
    rows = clean(spark, [(3, 7, "q", "q"), (2, 5, "q", "Q!"), (1, 5, "q", "qQ"), (9, 1, "z", "Z")])
    got = {r.query_norm: (r.delta, r.display) for r in fold.fold(rows).collect()}
    assert got == {"q": (3, "qQ"), "z": (1, "Z")}


def test_folding_folds_equals_folding_everything(spark, values):
    rows = clean(spark, [(i, i * 7 % 100, f"q{i % 5}", f"D{i}") for i in range(300)])
    parts = [fold.fold(rows.where(F.col("event_id") % 3 == k)) for k in range(3)]
    cols = ["query_norm", "delta", "display", "last_ts"]
    assert values(fold.merge_folds(*parts), *cols) == values(fold.fold(rows), *cols)


def test_totals_do_not_depend_on_flush_boundaries(spark, values):
    rows = clean(spark, [(i, i, f"q{i % 4}", f"Q{i % 4}" if i % 2 else f"q{i % 4}") for i in range(200)])
    totals = []
    for threshold, interval in ((7, 50), (500, 5), (1, 1000)):
        flushed = fold.fold(fold.assign_flushes(rows, threshold, interval), fold.FLUSH)
        merged = merge.upsert(spark.createDataFrame([], merge.DICTIONARY), merge.deltas_as_rows(flushed))
        totals.append(values(merged.groupBy("query_norm").agg(F.sum("count").alias("c"))))
    assert totals[0] == totals[1] == totals[2]


def test_requeue_keeps_the_waiting_display(spark, values):
    newer = fold.fold(clean(spark, [(5, 50, "q", "New"), (6, 51, "n", "N")]))
    failed = fold.fold(clean(spark, [(1, 1, "q", "Old"), (2, 2, "q", "Old"), (3, 3, "f", "F")]))
    assert values(fold.requeue(newer, failed), "query_norm", "delta", "display") == [
        ("f", 1, "F"), ("n", 1, "N"), ("q", 3, "New")]


def test_write_reduction(spark):
    rows = clean(spark, [(i, 0, f"q{i % 3}", "d") for i in range(1000)])
    flushed = fold.fold(fold.assign_flushes(rows), fold.FLUSH)
    assert tuple(fold.write_reduction(flushed).first()) == (1000, 6, 2, 166.6667, 99.4)
    assert tuple(fold.write_reduction(flushed.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)


def test_requests_become_usable_events(spark, values):
    asked = spark.createDataFrame([(1, "  Red  Shoes\t"), (2, " "), (3, None), (4, "x" * 513)], "event_id long, query string")
    checked = fold.check_requests(asked)
    assert values(checked.where("error is not null"), "event_id") == [(2,), (3,), (4,)]
    sent = fold.to_event(checked.where("error is null").drop("error"))
    assert values(sent, "event_id", "q", "d") == [(1, "red  shoes", "Red  Shoes")]


def test_malformed_events(spark, values):
    raw = spark.createDataFrame([(1, "q", "Q"), (2, "q", None), (3, None, "Q")], "event_id long, q string, d string")
    assert values(fold.usable_events(raw), "event_id", "query_norm", "display") == [(1, "q", "Q"), (2, "q", "q")]
    assert values(fold.unusable_events(raw), "event_id") == [(3,)]


def test_event_log_is_partitioned_by_day(spark, tmp_path):
    rows = clean(spark, [(1, 0, "a", "A"), (2, 86_400, "b", "B")]).withColumnsRenamed({"query_norm": "q", "display": "d"})
    path = str(tmp_path / "log")
    log.append_events(rows, path)
    log.append_events(rows.where("event_id = 2"), path)
    assert log.read_events(spark, path).count() == 3
    assert sorted(p.name for p in (tmp_path / "log").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02"]


def test_upsert(spark):
    at = [F.lit(f"2024-01-0{d}").cast("timestamp") for d in (1, 2, 3)]
    base = merge.as_dictionary(spark.createDataFrame([("A b", 5), ("c", 1)], "query string, count long"), at[0])
    delta = merge.as_dictionary(spark.createDataFrame([("A b", 2), ("new", 4)], "query string, count long"), at[1])
    later = merge.as_dictionary(spark.createDataFrame([("A b", 1)], "query string, count long"), at[2])
    got = {r["query"]: (r.query_norm, r["count"], r.last_searched_at.day, r.created_at.day)
           for r in merge.upsert(base, delta, later).collect()}
    assert got == {"A b": ("a b", 8, 3, 1), "c": ("c", 1, 1, 1), "new": ("new", 4, 2, 2)}
