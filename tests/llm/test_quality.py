import numpy as np
import pytest
from pyspark.sql import functions as F

from keystride.llm import quality
from keystride.llm.queries import QUERIES, quality_model


def test_pooled_levels_never_fall():
    assert quality.pool_adjacent([0.1, 0.5, 0.3, 0.9], [1, 1, 1, 1]) == pytest.approx([0.1, 0.4, 0.4, 0.9])
    assert quality.pool_adjacent([3, 2, 1], [1, 1, 2]) == pytest.approx([1.75] * 3)
    assert quality.pool_adjacent([], []) == []


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\n", "\x00", "a", "A" * 50000, "日本 語", "| | |", "x\n" * 4000):
        got = quality.statistics(text)
        assert len(got) == quality.STATISTICS and np.isfinite(got).all()


def test_partition_sums_equal_the_whole(spark):
    draw = np.random.default_rng(0)
    stats = draw.normal(size=(50, quality.STATISTICS))
    labels = draw.integers(0, 2, 50).astype(float)
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS),
                          draw.normal(size=(quality.STATISTICS, 8)), draw.uniform(size=8), np.zeros(9), np.zeros(1), np.zeros(1))
    frame = spark.createDataFrame([(s.tolist(), float(y)) for s, y in zip(stats, labels)], "stats array<double>, label double")
    gram, right = quality.partition_sums(frame.repartition(7), model)
    z = model.fourier(stats)
    assert np.allclose(gram, z.T @ z) and np.allclose(right, z.T @ labels)


def test_held_out_rows_are_judged_right(spark, small):
    got = QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    row = got.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"),
                                    F.min("score"), F.max("score")).first()
    assert row.n > 50 and row.right >= 0.95 and row[2] >= 0 and row[3] <= 1


def test_odd_rows_and_labels(docs, spark):
    frame = docs((1, None), (2, ""), (3, "x"), (3, "x"), (None, "y")).withColumn("score", F.lit(1))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    scored = quality.score(frame, quality.fit(frame, none), ["doc_id"])
    assert [r.score for r in scored.collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id bigint, quality int")
    assert {r.score for r in quality.score(frame, quality.fit(frame, one), ["doc_id"]).collect()} == {1.0}
    assert quality.score(frame.limit(0), quality.fit(frame, one), ["doc_id"]).count() == 0


def test_other_columns_are_no_inputs(small):
    model = quality_model(small("documents"), small("labels"))
    changed = small("documents").withColumns({"lang": F.lit("zz"), "source": F.lit("?"), "doc_id": F.col("doc_id") + 10 ** 6})
    a = sorted(r.score for r in quality.score(small("documents"), model, []).collect())
    assert a == sorted(r.score for r in quality.score(changed, model, []).collect())
