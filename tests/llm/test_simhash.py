import re

import numpy as np
import xxhash

from keystride.llm import simhash
from keystride.llm.common import connected_components


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)][:len(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_classes(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2 ** 64 - 1)).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((repr(rows[i][0]), prints[i], least.get(find(i))) for i in range(len(rows)))


def got(frame):
    return sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.group(frame).collect())


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "a b c d"), (8, "A B C D"), (8, "A B C D"),
       (9, "x" * 20000), (10, "é b c d e"), (None, "q r s t u"), (None, "q r s t u"), (11, "w " * 5000)]


def test_fingerprints_and_classes_of_odd_texts(docs):
    assert got(docs(*ODD)) == brute_classes(ODD)


def test_small_tables(small):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    assert got(small("documents")) == brute_classes(rows)


def test_all_pairs_within_the_radius_are_met(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(-2 ** 63, 2 ** 63 - 1, 60)
    values = set(base.tolist())
    for b in base.tolist():
        for k in (1, 2, 3, 4):
            flips = sum(1 << int(i) for i in draw.choice(64, k, replace=False))
            v = (b ^ flips) & (2 ** 64 - 1)
            values.add(v - 2 ** 64 if v >> 63 else v)
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    for segments in (2, 3, 4):
        assert {tuple(r) for r in simhash.near_pairs(frame, 3, segments).collect()} == want


def test_one_row_of_each_class_stays(docs):
    kept = simhash.keep_one(docs(*ODD))
    assert kept.columns == docs("x").columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {c for *_, c in brute_classes(ODD)}
    assert sorted(i for i in ids if i is not None) == sorted(c for c in classes if c is not None)
    assert ids.count(None) == 1
    assert simhash.keep_one(docs("x").limit(0)).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1100)]
    edges = spark.createDataFrame(path + star + [(5000, 5000), (3, 2)], "a bigint, b bigint")
    roots = {r.v: r.root for r in connected_components(edges).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[i] for i in range(1000, 1100)}) == 1
    assert roots[0] != roots[1000] and 5000 not in roots
    assert connected_components(edges.limit(0)).count() == 0
