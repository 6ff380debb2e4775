import random

import pytest

from keystride.llm import license_join
from keystride.llm.queries import ORACLE

ODD = [
    (1, None), (2, ""), (3, "MIT License"), (4, "mit\nlicense, MIT  license"), (5, "x mit license mit license y\nApache License"),
    (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0."), (7, "no licenses here: mit licensed"),
    (8, "the GNU General Public License, version 3\nThis work is licensed under the GNU General Public License, version 3."),
    (9, "word " * 20000 + "mit license"), (10, "mitK license ſ MİT LICENSE"), (None, "Released under the MIT License."),
    (12, "\x00mit\x7flicense"), (13, "GENERAL PUBLIC LICENSE"), (14, "mit license\n" * 300),
    (15, "version 2.0 of the apache license under which this is licensed"), (16, "!!! ... \n\n"),
]


def scanned(frame):
    return license_join.scan(frame)[0]


def test_odd_texts_equal_sql(docs, answers, plain):
    frame = docs(*ODD)
    assert plain(scanned(frame)) == answers(ORACLE["op5_license_join"], documents=frame)


def test_empty_table_and_clashing_names(docs, plain):
    frame = docs(*ODD)
    assert scanned(frame.limit(0)).count() == 0
    wide = frame.selectExpr("*", "'?' AS words", "'?' AS label", "'?' AS row", "'?' AS base")
    assert plain(scanned(wide)) == plain(scanned(frame))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_the_join_is_exact(spark, threshold):
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    pick = lambda n: sorted(set(draw.choices(vocabulary, weights, k=n)))
    templates = [(i, " ".join(pick(draw.randint(1, 12))), f"l{i}") for i in range(12)]
    sets = [pick(draw.randint(1, 20)) for _ in range(300)] + [[w] for w in vocabulary[:3]]
    frame = spark.createDataFrame([(s,) for s in sets], "words array<string>")
    table = spark.createDataFrame(templates, "template int, text string, label string")
    got = {(tuple(r.words), r.template, round(r.containment, 9)) for r in license_join.similarity_join(frame, table, threshold).collect()}
    want = set()
    for s in sets:
        for i, text, _ in templates:
            t = set(text.split())
            if len(t & set(s)) / len(t) >= threshold - 1e-9:
                want.add((tuple(s), i, round(len(t & set(s)) / len(t), 9)))
    assert got == want


def test_blocks_are_named(docs):
    blocks = license_join.scan(docs((1, "a\nReleased under the MIT License.\nb")))[1]
    assert [(r.doc_id, r.start, r.label, r.containment) for r in blocks.orderBy("start").collect()] == [(1, 1, "mit", 1.0)]


def labels_of(docs, *texts):
    rows = license_join.scan(docs(*texts))[0].collect()
    return [r.labels for r in sorted(rows, key=lambda r: r.doc_id)]


def test_every_notice_labels_a_text(docs):
    mozilla = "This Source Code Form is subject to the terms of the Mozilla public license"
    assert labels_of(
        docs, f"{mozilla}; docs licensed under CC BY 4.0", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC 4.0, and the text is licensed under CC BY 4.0.") == ["cc-by,mpl", "cc-by-nc,cc-by-sa", "cc-by", "cc-by,cc-by-nc"]


def test_a_block_runs_over_line_ends_and_ends_in_long_lines(docs):
    head = "Redistribution and use in source and binary forms, with or without"
    scattered = " ".join(f"filler{i} " + ("by cc 4 under 0 licensed".split()[i // 1000] if i % 1000 == 7 else "") for i in range(6000))
    assert labels_of(docs, f"x\n * {head}\n * modification, are permitted", scattered, head.replace("and", "\n\n")) == ["bsd", "", ""]


def test_more_words_than_an_array_may_hold_are_refused(spark, monkeypatch):
    monkeypatch.setattr(license_join, "MAX_TEMPLATE_WORDS", 2)
    frame = spark.createDataFrame([(["a"],)], "words array<string>")
    with pytest.raises(ValueError, match="distinct words"):
        license_join.similarity_join(frame, license_join.template_table(spark, [("a b c", "x")]))


def test_no_python_in_the_plan(docs):
    plan = scanned(docs("mit license"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
