import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from keystride.operators import prefix, trending
from keystride.sources.scores import ScoreStore

START = dt.datetime(2024, 1, 1)
H = 3600.0


def events(spark, rows):
    """Rows of (query, seconds after the start)."""
    return spark.createDataFrame([(q, START + dt.timedelta(seconds=s)) for q, s in rows], "query_norm string, t timestamp_ntz").select(
        "query_norm", F.col("t").cast("timestamp").alias("ts"))


@pytest.fixture(scope="module")
def history():
    rng = random.Random(11)
    return [(f"q{min(rng.randrange(12), rng.randrange(12))}", rng.randrange(40 * 3600)) for _ in range(800)]


def direct(history, at_seconds):
    out = {}
    for q, s in history:
        if s <= at_seconds:
            out[q] = out.get(q, 0.0) + 2.0 ** (-(at_seconds - s) / H)
    return out


def as_map(scores):
    return {r.query_norm: r.score for r in scores.collect()}


def moment(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_decayed_scores(spark, history):
    got = as_map(trending.decayed_scores(events(spark, history), moment(100_000)))
    assert got == pytest.approx(direct(history, 100_000), rel=1e-9)


def test_order_does_not_depend_on_the_reference_time(spark, history):
    rows = events(spark, history)
    orders = [
        [q for q, _ in sorted(as_map(trending.decayed_scores(rows, moment(at))).items(), key=lambda kv: kv[1])]
        for at in (150_000, 500_000)
    ]
    assert orders[0] == orders[1]


def test_reanchoring_and_adding(spark, history):
    rows = events(spark, history)
    cut = moment(70_000)
    early = trending.decayed_scores(rows.where(F.col("ts") <= F.lit(cut)), cut)
    late = trending.decayed_scores(rows.where(F.col("ts") > F.lit(cut)), moment(150_000))
    assert as_map(trending.add_scores(early, late, moment(150_000))) == pytest.approx(direct(history, 150_000), rel=1e-9)


def test_partials_give_the_same_total(spark, history):
    partials = trending.score_partials(events(spark, history), "1 hour")
    assert as_map(trending.scores_from_partials(partials, moment(144_000))) == pytest.approx(direct(history, 144_000), rel=1e-9)


@pytest.mark.parametrize("gap_hours", [1, 300, 900])
def test_running_scores_over_long_gaps(spark, gap_hours):
    """Weights relative to one origin would overflow here."""
    hours = [0, 1, 2, gap_hours + 2, 2 * gap_hours + 2, 2 * gap_hours + 5000]
    rows = events(spark, [("q", 3600 * h + 1800) for h in hours])
    running = trending.running_scores(trending.score_partials(rows, "1 hour"))
    got = [r.score for r in running.orderBy("window_end").collect()]
    wanted, score, before = [], 0.0, None
    for h in hours:
        score = score * (2.0 ** -(h - before) if before is not None else 0.0) + 2.0 ** -0.5
        before = h
        wanted.append(score)
    assert got == pytest.approx(wanted, rel=1e-9)


def dictionary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "query string, count long").withColumn("query_norm", F.lower("query"))


def blend(scores, counts, size, leaders):
    top = sorted(scores.items(), key=lambda kv: (round(kv[1], 12), kv[0]), reverse=True)[:leaders]
    best = {}
    for q, c in counts.items():
        best[q.lower()] = max(best.get(q.lower(), -10 ** 9), c)
    max_count = max([1, *(best.get(q, 0) for q, _ in top)])
    max_score = max(s for _, s in top) or 1
    ranked = sorted(
        ((round(0.5 * best.get(q, 0) / max_count + 0.5 * s / max_score, 9), s, q) for q, s in top), reverse=True)
    return [q for _, _, q in ranked[:size]]


COUNTS = {"Q1": 40, "q1": 30, "q2": 35, "q5": 100, "other": 500, "q7": 2}


def test_trending_recency(spark, history):
    scores = trending.decayed_scores(events(spark, history), moment(150_000))
    got = trending.trending_recency(dictionary(spark, COUNTS), scores, 4).orderBy("rank").collect()
    assert [r.query for r in got] == blend(direct(history, 150_000), COUNTS, 4, 12)
    shown = {r.query: (r.display, r["count"]) for r in got}
    assert shown.get("q1", ("Q1", 40)) == ("Q1", 40)
    assert {r.source for r in got} == {"COMPUTED"}


def test_cold_start_falls_back(spark):
    nothing = trending.decayed_scores(events(spark, [("q1", 10)]), START - dt.timedelta(days=1))
    got = trending.trending_recency(dictionary(spark, COUNTS), nothing, 3).orderBy("rank").collect()
    assert [r.query for r in got] == ["other", "q5", "Q1"]
    assert {(r.mode, r.source) for r in got} == {("RECENCY", "FALLBACK_POPULARITY")}


def test_best_of_norm_and_leader_ties(spark, values):
    got = values(trending.best_of_norm(dictionary(spark, {"A": 3, "a": 3, "b": 1, "B": 2})))
    assert got == [("a", "A", 3), ("b", "B", 2)]
    tied = spark.createDataFrame([("a", 1.0), ("c", 1.0), ("b", 1.0)], "query_norm string, score double")
    assert [r.query_norm for r in trending.score_leaders(tied, 2).collect()] == ["c", "b"]


@pytest.mark.parametrize("size", [1, 3])
def test_snapshots_equal_single_trending_lists(spark, history, size):
    partials = trending.score_partials(events(spark, history), "1 hour")
    lists = trending.trending_snapshots(
        partials, dictionary(spark, COUNTS), START, moment(45 * 3600), 3600, size=size).collect()
    by_hour = {}
    for r in sorted(lists, key=lambda r: r.rank):
        by_hour.setdefault(r.snapshot, []).append(r.query)
    for hour in range(46):
        # A snapshot sees windows that ended by its time.
        seen = direct([(q, s) for q, s in history if s < hour * 3600], hour * 3600)
        popular = sorted(COUNTS, key=lambda q: (-COUNTS[q], q))[:size]
        wanted = blend(seen, COUNTS, size, 3 * size) if seen else popular
        assert by_hour.get(hour, []) == wanted, hour


def test_whole_blocks_cover_every_snapshot_once(spark):
    spans = [(a, b) for a in range(0, 20, 3) for b in range(a + 1, 33, 4)] + [(0, 32), (5, 6), (31, 32)]
    rows = spark.createDataFrame(spans, "a long, b long")
    got = rows.select("a", "b", trending._whole_blocks(F.col("a"), F.col("b"), 5).alias("blocks")).collect()
    for r in got:
        covered = [i for x in r.blocks for i in range(x.block * 2 ** x.level, (x.block + 1) * 2 ** x.level)]
        assert sorted(covered) == list(range(r.a, r.b))
        assert len(r.blocks) <= 2 * math.ceil(math.log2(r.b - r.a + 1) + 1)


def test_score_store_adds_up(spark, history, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "scores"))
    assert store.read().isEmpty()
    rows = events(spark, history)
    for part, cut in enumerate((50_000, 100_000, 150_000)):
        span = (F.col("ts") > F.lit(moment(cut - 50_000) if part else moment(-1))) & (F.col("ts") <= F.lit(moment(cut)))
        assert store.add(rows.where(span), moment(cut)) == part
    assert as_map(store.read()) == pytest.approx(direct(history, 150_000), rel=1e-9)


def test_modes(spark, history):
    table = dictionary(spark, COUNTS)
    scores = trending.decayed_scores(events(spark, history), moment(150_000))
    modes = {m: trending.trending(table, scores, m).first()["mode"] for m in ("POPularity", "recency", "x")}
    assert modes == {"POPularity": "POPULARITY", "recency": "RECENCY", "x": "RECENCY"}
    plain = [r["query"] for r in prefix.suggest(table, scores, "q", "other").orderBy("rank").collect()]
    assert plain == ["q5", "Q1", "q2", "q1", "q7"]
    assert [r["query"] for r in prefix.suggest(table, scores, "q", source="trie").orderBy("rank").collect()] == ["q5", "q1", "q2", "q7"]
    assert prefix.suggest(table, scores, "q", "RECENCY").count() == 5


def test_order_does_not_depend_on_the_clock(spark):
    """Half-lives of an hour: at +60 days every score has left a double's range."""
    rows = [("a", "2024-01-01 00:00:00")] * 5 + [("z", "2024-01-01 00:00:00"), ("old", "2022-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "query_norm string, t string").select("query_norm", F.col("t").cast("timestamp").alias("ts"))
    table = spark.createDataFrame([("a", "a", 5), ("z", "z", 9), ("old", "old", 1)], "query string, query_norm string, count long")
    lists = []
    for as_of in ("2024-01-01 01:00:00", "2024-01-03 00:00:00", "2024-03-01 00:00:00"):
        scores = trending.decayed_scores(events, as_of, 3600.0)
        top = trending.trending_recency(table, scores)
        lists.append([(r["query"], round(r.blended, 9)) for r in top.orderBy("rank").collect()])
        moved = trending.reanchor(trending.decayed_scores(events, "2024-01-01 00:00:00", 3600.0), as_of, 3600.0)
        levels = {r.query_norm: r.level for r in scores.collect()}
        assert {r.query_norm: round(r.level, 6) for r in moved.collect()} == {k: round(v, 6) for k, v in levels.items()}
        assert levels["a"] > levels["z"] > levels["old"]
    assert lists[0] == lists[1] == lists[2] and lists[0][0][0] == "a"


def test_snapshot_without_scores_shows_popularity(spark):
    partials = spark.createDataFrame([], "query_norm string, window_end timestamp, partial double")
    table = spark.createDataFrame([("A", "a", 5), ("b", "b", 9)], "query string, query_norm string, count long")
    got = trending.trending_snapshots(partials, table, "2024-01-01 00:00:00", "2024-01-02 00:00:00", 86_400)
    assert sorted((r.snapshot, r["rank"], r["query"], r.source) for r in got.collect()) == [
        (s, i, q, "FALLBACK_POPULARITY") for s in (0, 1) for i, q in ((1, "b"), (2, "A"))]
