from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from keystride.llm import mixing, quality, simhash, toxicity
from keystride.llm.queries import quality_model, toxicity_model
from keystride.session import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_their_operators_one_by_one(spark, small):
    docs, labels = small("documents"), small("labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, quality_model(docs, labels), ["doc_id"]).where("predicted = 1").collect()}
    first = corpus_pipeline.keep_quality(spark, docs, SMALL)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good
    toxic = {r.doc_id for r in toxicity.score(first, toxicity_model(first, labels), ["doc_id"]).where("predicted = 1").collect()}
    second = corpus_pipeline.drop_toxic(spark, first, SMALL)
    assert {r.doc_id for r in second.collect()} == good - toxic
    third = corpus_pipeline.drop_near_copies(spark, second, SMALL)
    kept = {r.component_id for r in simhash.group(second).collect()}
    assert {r.doc_id for r in third.collect()} == kept and third.count() == len(kept)
    fourth = corpus_pipeline.mix_sources(spark, third, SMALL)
    assert fourth.columns == docs.columns
    times = Counter(r.doc_id for r in fourth.collect())
    assert set(times) == kept and max(times.values()) <= 3
    last = corpus_pipeline.tokenize(spark, fourth, SMALL).collect()
    assert Counter(r.doc_id for r in last) == times and all(len(r.ids) == r.n_tokens for r in last)
    assert all(texts[r.doc_id] for r in last)


def test_columns_of_any_name_and_repeated_rows_pass_through(spark, small):
    names = ["predicted", "score", "_n", "_kept", "pass", "row", "text_", "fingerprint"]
    docs = small("documents").select("*", *[F.lit(77 + i).alias(n) for i, n in enumerate(names)])
    plain = small("documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "near_copies":  # repeated rows and one without an id; before, they would train another model
            some = docs.limit(20)
            docs = materialize(docs.unionByName(some).unionByName(some.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))))
        kept = materialize(stage(spark, docs, SMALL))
        assert kept.columns == docs.columns, name
        assert {tuple(r)[-len(names):] for r in kept.collect()} == {tuple(range(77, 77 + len(names)))}
        ids = {r.doc_id for r in stage(spark, plain, SMALL).collect()}
        assert {r.doc_id for r in kept.collect()} - {None} == ids
        docs, plain = kept, materialize(stage(spark, plain, SMALL))
    assert corpus_pipeline.tokenize(spark, docs, SMALL).count() == docs.count()


def test_mixing_reads_each_document_as_often_as_its_source_is(spark, docs):
    """Counted by hand: sources of 60, 30 and 10 tokens whose shares are tempered, all read whole."""
    rows = docs(*[(i, "w " * 10) for i in range(10)], sources={i: "abc"[(i > 5) + (i > 8)] for i in range(10)})
    times = Counter(r.source for r in corpus_pipeline.mix_sources(spark, rows, SMALL).collect())
    sources = mixing.plan(mixing.counted_documents(rows), corpus_pipeline.MIX_ENTROPY, corpus_pipeline.MIX_REPETITION).collect()
    for r in sources:
        assert r.tokens <= r.goal <= 2 * r.tokens and r.passes >= 1
        assert times[r._source[1:]] == r.docs * r.passes + -(-r.rest // 10)


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "ids", "ids_sha256"} <= set(got.columns) and got.count() > 50
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_copies", "mixing", "tokens"]


def test_empty_documents(spark, tmp_path, small):
    for name in ("documents", "labels"):
        small(name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
