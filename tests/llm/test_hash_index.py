import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keystride.llm import hash_index, oracle


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), place == 0, digest) for place, i in enumerate(ids)]
    return sorted(out, key=repr)


def got(frame, **bounds):
    return sorted((tuple(r) for r in hash_index.group(frame, **bounds).collect()), key=repr)


ODD = [(1, None), (2, ""), (3, " "), (4, "\t\n "), (5, "a b"), (6, "a  b"), (7, "a\tb"), (8, "a b"), (9, " a b"), (9, "a b"),
       (10, "a b "), (11, "A b"), (12, "x" * 50000), (13, "x" * 50000), (14, "x" * 49999), (15, "a\x1cb"),
       (None, "a b"), (None, "n"), (None, "n"), (16, "é"), (17, "é"), (18, "r"), (18, "r"), (18, "r"), (19, "r")]


@pytest.mark.parametrize("key_bits", [64, 3, 1])
def test_groups_of_odd_texts_whatever_collides(docs, key_bits):
    assert got(docs(*ODD), key_bits=key_bits) == brute(ODD)


def test_split_buckets_and_pages_give_the_same_groups(docs):
    rows = [(i, f"text {i % 60}" + " " * (i % 3)) for i in range(400)] + [(1000 + i, "hot\n copy") for i in range(300)]
    frame = docs(*rows).repartition(7)
    index = hash_index.build(frame, bucket_bytes=200, bucket_rows=20)
    buckets = index.directory.collect()
    assert max(b.depth for b in buckets) > 2
    assert all(b.n_keys == 1 or (b.n_rows <= 20 and b.n_bytes <= 200) for b in buckets)
    assert sum(b.pages > 5 for b in buckets) == 1
    assert index.buckets.select("bucket", "page").distinct().count() > len(buckets)
    assert sorted((tuple(r) for r in hash_index.group(frame, index=index).collect()), key=repr) == brute(rows)


def test_small_tables_and_sql(small, plain, answers):
    found = hash_index.group(small("documents"))
    assert plain(found) == answers(oracle.exact_dedup())
    assert got(small("documents")) == brute([(r.doc_id, r.text) for r in small("documents").collect()])


def test_texts_are_shuffled_to_many_keys(docs, monkeypatch):
    monkeypatch.setattr(hash_index, "MAX_BROADCAST_ROWS", 0)
    assert got(docs(*ODD)) == brute(ODD)


def test_empty_table_and_clashing_names(docs):
    assert got(docs()) == []
    frame = docs((1, "a"), (2, "a")).select("doc_id", "text", *[
        F.lit(9).alias(n) for n in ("key", "norm", "n", "bucket", "page", "pages", "uid", "chain", "kept", "keep_id", "text_sha256")])
    assert [r[:4] for r in got(frame)] == [(1, 1, 2, True), (2, 1, 2, False)]
    assert [r.doc_id for r in hash_index.keep_one(frame).collect()] == [1]


def test_no_python_on_the_main_path(docs):
    plan = hash_index.group(docs(*ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
