import pytest
from pyspark.sql import functions as F

from keystride.llm import toxicity
from keystride.llm.queries import QUERIES

PROSE = "the moron is a stupid person in this house and the idiot was here with an example of the pathetic loser on the street "


@pytest.fixture(scope="module")
def restorer(docs):
    counts = toxicity.letter_counts(docs(PROSE * 50, "another line of plain words about nothing at all " * 30)).collect()
    return toxicity.Restorer(toxicity.language_model([(r.trigram, r.n) for r in counts]))


@pytest.mark.parametrize("noisy, plain", [
    ("m0ron", "moron"), ("1d10t", "idiot"), ("st*pid", "stupid"), ("$tupid", "stupid"), ("m.o.r.o.n", "moron"),
    ("s t u p i d", "stupid"), ("stuuuuupid", "stupid"), ("l0$er", "loser"), ("p@th3tic", "pathetic"), ("moron", "moron"),
])
def test_noisy_words_are_restored(restorer, noisy, plain):
    assert restorer.restore(noisy) == plain


def brute_restore(costs, word):
    """All paths of the lattice."""
    paths = [("", 0.0)]
    for step in toxicity.Restorer.lattice(word):
        paths = [(w + out, c + extra) for w, c in paths for out, extra in step]

    def total(path):
        places = [0, 0, *[toxicity._PLACE.get(c) or toxicity._PLACE[toxicity.fold(c)] for c in path[0]], 0]
        return path[1] + sum(costs[a][b][c] for a, b, c in zip(places, places[1:], places[2:]))

    return min(map(total, paths)), {w for w, c in paths}, total


@pytest.mark.parametrize("word", ["m0r0n", "1d1*t", "aaab", "h3ll0", "a.b-c"])
def test_viterbi_finds_the_least_cost(restorer, word):
    best, words, total = brute_restore(restorer.costs, word)
    got = restorer.restore(word)
    assert got in words
    costs = [c for c in _costs_of(restorer, word, got)]
    assert min(costs) == pytest.approx(best)


def _costs_of(restorer, word, wanted):
    paths = [("", 0.0)]
    for step in toxicity.Restorer.lattice(word):
        paths = [(w + out, c + extra) for w, c in paths for out, extra in step]
    for w, c in paths:
        if w == wanted:
            places = [0, 0, *[toxicity._PLACE.get(x) or toxicity._PLACE[toxicity.fold(x)] for x in w], 0]
            yield c + sum(restorer.costs[a][b][d] for a, b, d in zip(places, places[1:], places[2:]))


def test_letter_counts_add_up_over_partitions(docs):
    frame = docs("abc abd", "abc", "ABC, x1y", None, "")
    one = {r.trigram: r.n for r in toxicity.letter_counts(frame.coalesce(1)).collect()}
    assert one == {r.trigram: r.n for r in toxicity.letter_counts(frame.repartition(5)).collect()}
    place = toxicity._PLACE
    assert one[(place["a"] * toxicity.N + place["b"]) * toxicity.N + place["c"]] == 3
    assert sum(one.values()) == 4 * 4


def test_disguised_words_score_like_plain_ones(docs, spark):
    clean = ["the house was here in the street and plain", "an example of this is nothing at all with words"]
    texts = [(i, f"{clean[i % 2]} {'moron' if i % 3 == 0 else 'person'} {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(*texts), labels)
    asked = docs((1, "a m0r0n was here"), (2, "a m o r o n was here"), (3, "a person was here"), (4, None), (5, ""),
                 (6, "moooron in the house"))
    got = {r.doc_id: r.predicted for r in toxicity.score(asked, model, ["doc_id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
    assert "moron" in toxicity.restore(asked, model, ["doc_id"]).where("doc_id = 1").first().restored


def test_spelled_runs_are_decoded_to_words(restorer):
    assert restorer.restore("t h e i d i o t w a s h e r e", boundaries=True).split() == ["the", "idiot", "was", "here"]
    for run in ("x i d i o t", "i\td\ti\to\tt", "i  d\n i  o  t", "b a d"):
        assert restorer.words(f"plain {run} words")[1]
    assert not restorer.words("plain a b words")[1]


def test_spread_and_cut_words_score_like_plain_ones(docs, spark):
    clean = ["the house was here in the street and plain", "an example of this is nothing at all with words"]
    texts = [(i, f"{clean[i % 2]} {'idiot' if i % 3 == 0 else 'person'} {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(*texts), labels)
    scorer = model.scorer()
    for noisy in ("t h e i d i o t w a s h e r e", "this i  d  i  o  t here", "this i\td\ti\to\tt here", "i\nd\ni\no\nt",
                  "an id iot was here", "an idi ot was here", "an id io t was here", "an idi-ot was here"):
        assert scorer(noisy) >= toxicity.THRESHOLD, noisy
    for plain in ("a person was here", "a person with an id was here", "p e r s o n", "the i d of a person"):
        assert scorer(plain) < toxicity.THRESHOLD, plain


def test_held_out_rows_are_judged_right(spark):
    got = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    row = got.agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"),
                  F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found")).first()
    assert row.n > 300 and row.right >= 0.97 and row.found >= 0.85


def test_labels_of_one_kind_and_odd_rows(docs, spark):
    frame = docs((1, None), (2, ""), (3, "x" * 30000), (3, "y"), (None, "z"))
    for rows, want in (([], 0), ([(1, 0), (2, None)], 0), ([(3, 1)], 1)):
        labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
        got = toxicity.score(frame, toxicity.fit(frame, labels), ["doc_id"]).collect()
        assert len(got) == 5 and {r.predicted for r in got} <= {0, 1} and (not rows or {r.predicted for r in got} == {want})
    assert toxicity.score(frame.limit(0), toxicity.fit(frame, labels), ["doc_id"]).count() == 0
