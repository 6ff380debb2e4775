import random

import pytest
from pyspark.sql import functions as F

from keystride.operators import upkeep
from keystride.operators.merge import DICTIONARY, upsert
from keystride.operators.prefix import all_prefix_top
from keystride.sources.ranges import DictionaryRanges

AT = "2024-01-01 00:00:00"


def counts(spark, rows):
    """``(query, count)`` pairs in the dictionary's shape."""
    frame = spark.createDataFrame(rows, "query string, count bigint")
    at = F.lit(AT).cast("timestamp")
    return frame.select("query", F.lower("query").alias("query_norm"), "count", at.alias("last_searched_at"), at.alias("created_at"))


def words(draw, n):
    return ["".join(draw.choice("abAé_%") for _ in range(draw.randint(1, 5))) for _ in range(n)]


def files(table):
    return {(r.range_id, r.attempt) for r in table.manifest().collect()}


@pytest.fixture
def dictionary(spark, tmp_path):
    draw = random.Random(3)
    table = DictionaryRanges(spark, str(tmp_path / "d"), target_rows=60)
    table.load(counts(spark, [(w, draw.randint(1, 50)) for w in sorted(set(words(draw, 900)))]))
    return table


def test_ranges_cover_all_keys_in_order(dictionary):
    ranges = sorted(dictionary.manifest().collect(), key=lambda r: r.low)
    assert len(ranges) > 5 and ranges[0].low == "" and sum(r.n_rows for r in ranges) == dictionary.read().count()
    spans = sorted((dictionary._read([r]).agg(F.min("query_norm"), F.max("query_norm")).first()) for r in ranges)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_upsert_equals_merging_everything_and_keeps_other_files(spark, dictionary, values):
    names = [f.name for f in DICTIONARY]
    before, expected = files(dictionary), dictionary.read()
    deltas = counts(spark, [("bbb", 5), ("bbB", 2), ("bb_b", 1), ("bbb", 1)])
    assert dictionary.upsert(deltas, 4)
    want = values(upsert(expected, deltas), *names)
    assert values(dictionary.read(), *names) == want
    assert len(before - files(dictionary)) in (1, 2) and len(before & files(dictionary)) > 3
    assert not dictionary.upsert(deltas, 4) and values(dictionary.read(), *names) == want
    assert dictionary.through() == 4
    met = dictionary.read_for(deltas, "query_norm").inputFiles()
    assert 0 < len(met) < len(dictionary.read().inputFiles()) / 2


def test_grown_ranges_are_cut_and_old_files_removed(spark, dictionary, values):
    names = [f.name for f in DICTIONARY]
    grown = counts(spark, [(f"ab{i:04}", i) for i in range(500)])
    want = values(upsert(dictionary.read(), grown), *names)
    n = len(files(dictionary))
    dictionary.upsert(grown, 0)
    assert len(files(dictionary)) > n + 3 and max(r.n_rows for r in dictionary.manifest().collect()) <= 160
    assert values(dictionary.read(), *names) == want
    dictionary.vacuum()
    assert values(dictionary.read(), *names) == want
    dictionary.upsert(counts(spark, [("ab0001", 1), ("zz", 1), ("", 3)]), 1)
    assert values(dictionary.read().where("query in ('ab0001', 'zz', '')"), "query", "count") == [("", 3), ("ab0001", 2), ("zz", 1)]


def test_reading_by_beginning_prunes_ranges(dictionary, values):
    for prefix in ("a", "ab", "é", "", "\U0010ffff"):
        found = dictionary.read_starting(prefix).where(F.startswith("query_norm", F.lit(prefix)))
        assert values(found, "query") == values(dictionary.read().where(F.startswith("query_norm", F.lit(prefix))), "query")
    assert len(dictionary.read_starting("ab").inputFiles()) < len(dictionary.read().inputFiles()) / 2


def test_empty_tables(spark, tmp_path):
    table = DictionaryRanges(spark, str(tmp_path / "e"))
    assert table.read().count() == 0 and table.through() == -1
    table.load(counts(spark, []))
    assert table.read().count() == 0 and table.read_starting("a").count() == 0
    table.upsert(counts(spark, []), 0)
    table.upsert(counts(spark, [("b", 1)]), 1)
    assert table.read().count() == 1 and table.through() == 1


LIST = ["prefix", "rank", "query", "count"]


@pytest.mark.parametrize("spare", [0, 3])
def test_lists_after_changes_equal_lists_computed_afresh(spark, dictionary, values, tmp_path, spare):
    draw = random.Random(5)
    lists = upkeep.PrefixLists(spark, str(tmp_path / "l"), k=4, spare=spare, target_rows=300)
    lists.build(dictionary)
    anew = []
    for batch in range(3):
        known = [r.query for r in dictionary.read().select("query").orderBy("query").collect()]
        rows = [(draw.choice(known), draw.randint(1, 30)) for _ in range(15)] + [(w, draw.randint(1, 60)) for w in words(draw, 6)]
        # Completions that sink: their prefixes run dry.
        rows += [(q, -40) for q in draw.sample(known, 12)] if batch else []
        deltas = counts(spark, rows)
        dictionary.upsert(deltas, batch)
        anew.append(lists.update(dictionary, deltas, batch))
        assert values(lists.lists(), *LIST) == values(all_prefix_top(dictionary.read(), 4), *LIST)
    assert anew[0] == 0 and (anew[1] > 0 or spare)


def test_deleted_queries_leave_the_lists(spark, dictionary, values, tmp_path):
    lists = upkeep.PrefixLists(spark, str(tmp_path / "l"), k=3, spare=1, target_rows=300)
    lists.build(dictionary)
    gone = dictionary.read().orderBy(F.desc("count"), "query").limit(40).select("query", "query_norm")
    gone = spark.createDataFrame(gone.collect(), gone.schema)
    dictionary.merge(gone, "query_norm", lambda rows, gone: rows.join(gone.select("query"), "query", "left_anti"))
    assert lists.update(dictionary, gone) > 0
    assert values(lists.lists(), *LIST) == values(all_prefix_top(dictionary.read(), 3), *LIST)


def test_only_changed_prefixes_are_ranked_again(spark, dictionary, values, tmp_path, monkeypatch):
    lists = upkeep.PrefixLists(spark, str(tmp_path / "l"), k=3, spare=3, target_rows=10_000)
    lists.build(dictionary)
    seen, apply = [], upkeep.apply_changes

    def watched(buffers, *rest):
        seen.extend(r.prefix for r in buffers.select("prefix").distinct().collect())
        return apply(buffers, *rest)

    monkeypatch.setattr(upkeep, "apply_changes", watched)
    query = dictionary.read().where("char_length(query_norm) > 2").orderBy("query").first().query_norm
    deltas = counts(spark, [(query, 1000)])
    dictionary.upsert(deltas)
    lists.update(dictionary, deltas)
    assert sorted(seen) == [query[:n] for n in range(1, len(query) + 1)]
    assert values(lists.lists(), *LIST) == values(all_prefix_top(dictionary.read(), 3), *LIST)


def test_an_update_reads_only_touched_ranges(spark, dictionary, tmp_path):
    lists = upkeep.PrefixLists(spark, str(tmp_path / "l"), k=3, spare=3, target_rows=60)
    lists.build(dictionary)
    before = files(lists)
    deltas = counts(spark, [("éa_x", 7)])
    dictionary.upsert(deltas)
    assert lists.update(dictionary, deltas) == 0
    assert len(before) > 10 and len(before - files(lists)) <= 3
