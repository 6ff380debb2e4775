import math

import pytest

from keystride.llm import mixing
from keystride.llm.queries import MIX_BLOCKS, MIX_ENTROPY, MIX_REPETITION, ORACLE


def counted(spark, sizes):
    """Sources with so many documents of so many tokens."""
    rows, i = [], 0
    for source, (n, tokens) in sizes.items():
        for _ in range(n):
            rows.append((i, None if source is None else source, " ".join(["w"] * tokens)))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def test_the_exponent_meets_the_entropy(spark):
    frame = mixing.counted_documents(counted(spark, {"a": (90, 10), "b": (9, 10), "c": (1, 10)}))
    plan = mixing.plan(frame, target_entropy=0.9, budget=1000)
    weights = [r.weight for r in plan.collect()]
    assert sum(weights) == pytest.approx(1) and entropy(weights) / math.log(3) == pytest.approx(0.9, abs=1e-4)


def test_the_repetition_limit_wins(spark):
    frame = mixing.counted_documents(counted(spark, {"a": (90, 10), "b": (9, 10), "c": (1, 10)}))
    for budget in (1000, None):
        rows = mixing.plan(frame, target_entropy=0.99, max_repetition=3, budget=budget).collect()
        assert max(r.goal / r.tokens for r in rows) == pytest.approx(3, abs=0.2)
    with pytest.raises(ValueError):
        mixing.plan(frame, max_repetition=3, budget=10_000)


def oracle():
    return ORACLE["op2_mixing"]


def as_query(frame, spark):
    parts = mixing.counted_documents(frame)
    budget = sum(r.n_tokens for r in parts.collect())
    from pyspark.sql import functions as F

    read = mixing.schedule(parts, mixing.plan(parts, MIX_ENTROPY, MIX_REPETITION, budget), blocks=MIX_BLOCKS)
    return read.select(
        F.col("_id").alias("doc_id"), F.when(F.col("_source").startswith("s"), F.expr("substring(_source, 2)")).alias("source"),
        "pass", "block", F.col("offset").alias("source_offset"), F.col("_key").alias("order_key"), "n_tokens")


def test_schedule_equals_sql_on_skewed_sources(spark, answers, plain):
    frame = counted(spark, {"a": (300, 7), "b": (20, 3), None: (5, 11), "d": (2, 0)})
    assert plain(as_query(frame, spark)) == answers(oracle(), documents=frame)


def test_repeated_rows_ties_nulls(spark, answers, plain, docs):
    frame = docs((1, "a b"), (1, "a b"), (2, None), (None, "c d e"), (None, "c d e"), (3, ""), (4, "x y z " * 4000))
    assert plain(as_query(frame, spark)) == answers(oracle(), documents=frame)


def test_the_mix_is_the_schedule(spark):
    frame = counted(spark, {"a": (200, 7), "b": (20, 3), None: (5, 11), "d": (2, 0)})
    parts = mixing.counted_documents(frame)
    read = mixing.schedule(parts, mixing.plan(parts, 0.9, 2.0)).groupBy("_id").count()
    want = sorted(tuple(r) for r in read.collect())
    mixed = mixing.mix(frame, 0.9, 2.0)
    assert mixed.columns == frame.columns
    got = sorted(tuple(r) for r in mixed.groupBy("doc_id").count().collect())
    assert got == want and {i for i, _ in got} == set(range(227))


def test_blocks_hold_every_source_in_proportion(spark):
    parts = mixing.counted_documents(counted(spark, {"a": (640, 5), "b": (320, 5)}))
    read = mixing.schedule(parts, mixing.plan(parts, budget=4800), blocks=8)
    held = {(r["block"], r["_source"]): r["n"] for r in read.groupBy("block", "_source").agg({"n_tokens": "sum"})
            .withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert {held[b, "sa"] for b in range(8)} == {400} and {held[b, "sb"] for b in range(8)} == {200}


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    frame = counted(spark, {"a": (50, 7), "b": (20, 3)})
    want = sorted(map(tuple, mixing.mix(frame, 0.99).select("doc_id").collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(frame, 0.99).select("doc_id").collect())) == want


def test_empty_table(spark):
    frame = counted(spark, {"a": (1, 1)}).limit(0)
    assert as_query(frame, spark).count() == 0 and mixing.mix(frame, 0.9, 2.0).count() == 0


def test_a_source_of_a_tiny_share_is_read_without_a_budget(spark):
    counted = spark.createDataFrame([("sbig", 10 ** 12), ("ssmall", 2)], "_source string, n_tokens bigint")
    got = {r._source: (r.goal, r.passes, r.rest) for r in mixing.plan(counted).collect()}
    assert got == {"sbig": (10 ** 12, 1, 0), "ssmall": (2, 1, 0)}


def test_a_source_of_a_tiny_share_is_read_within_a_budget(spark):
    counted = spark.createDataFrame([("big", 10**12), ("small", 40)], "_source string, n_tokens bigint")
    got = {r._source: r for r in mixing.plan(counted, None, None, 10**12 + 40).collect()}
    assert got["small"].passes == 1 and got["small"].rest == 0 and got["small"].weight > 0
