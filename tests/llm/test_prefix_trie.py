import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keystride.llm import oracle, prefix_trie

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tie(role, text):
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return [int.from_bytes(digest[i:i + 8], signed=True) for i in (0, 8)]


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    plain = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = plain.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def words(path):
        return len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0

    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(who) - 1) * words(path)
    out = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(sequences[c]) == len(path))))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids.get(path, [])),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(turns, convs, **bounds):
    return sorted((tuple(r) for r in prefix_trie.trie(turns, convs, **bounds).select(*NAMES).collect()), key=repr)


ODD = [(0, 0, "u", "a b"), (0, 1, "v", "c"), (0, 2, "u", "d e f"), (0, 3, "u", "x"), (1, 0, "u", "own"), (1, 1, "v", ""), (1, 2, "u", None),
       (2, None, None, "first"), (2, 5, "u", "later"), (2, None, "a", "first"), (3, 1, "u", "t"), (3, 1, "u", "t"), (4, 0, "u", "short"),
       (5, 0, "u", "s"), (6, 0, "u", "s"), (7, 0, "u", "one"), (7, 1, "u", "two"), (7, 2, "u", "three"), (7, 3, "u", "four"),
       (21, 0, "u", "no lender"), (22, 0, "u", "z"), (22, 1, "u", "y" * 5000), (22, 2, "", "q r"), (22, 3, "u", " \t\n"), (22, 4, "u", "é w"),
       (None, 0, "u", "nobody's"), (41, 0, "u", "a"), (42, 0, "ua", ""), (100000, 0, "u", "a b"), (100019, 0, "u", "a b"), (100003, 2, "x", "y")]


def test_odd_conversations(spark):
    turns, convs = prefix_trie.share_openings(prefix_trie.turns_of(spark.createDataFrame(ODD, CONVERSATIONS)))
    assert got(turns, convs) == brute(rebuilt(ODD))


@pytest.mark.parametrize("height", [1, 3, None])
@pytest.mark.parametrize("max_group_rows", [10, 10**6])
def test_deep_tries_by_bands_of_any_height(spark, height, max_group_rows):
    stem = [("u", f"turn {i}") for i in range(17)]
    sequences = {c: stem[:c % 13 + 4] + [("v", f"{c % 3} {j}") for j in range(c % 5)] for c in range(1, 30)}
    sequences[9000] = stem[:2]
    rows = [(c, i, *t) for c, turns in sequences.items() for i, t in enumerate(turns)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, CONVERSATIONS), max_group_rows=max_group_rows)
    convs = turns.select("conv_id").distinct()
    assert got(turns, convs, height=height, max_group_rows=max_group_rows) == brute(sequences)


def test_many_conversations_end_at_one_node(spark):
    rows = [(c * 3001, 0, "u", "hello there") for c in range(700)] + [(c, 0, "u", "hello there") for c in range(1, 3001)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, CONVERSATIONS))
    assert got(turns, turns.select("conv_id").distinct()) == brute({c: [("u", "hello there")] for c, *_ in rows})


def test_small_tables_and_sql(small, plain, answers):
    found = prefix_trie.trie(*prefix_trie.share_openings(prefix_trie.turns_of(small("conversations"))))
    assert plain(found) == answers(oracle.prefix_trie())
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in small("conversations").collect()]
    assert sorted((tuple(r) for r in found.select(*NAMES).collect()), key=repr) == brute(rebuilt(rows))


def test_sql_of_odd_conversations(spark, plain, answers):
    frame = spark.createDataFrame(ODD, CONVERSATIONS)
    found = prefix_trie.trie(*prefix_trie.share_openings(prefix_trie.turns_of(frame)))
    assert plain(found) == answers(oracle.prefix_trie(), conversations=frame)


def test_empty_table_and_clashing_names(spark):
    empty = prefix_trie.turns_of(spark.createDataFrame([], CONVERSATIONS))
    assert got(*prefix_trie.share_openings(empty)) == []
    frame = spark.createDataFrame(ODD, CONVERSATIONS).select("*", *[
        F.lit(1).alias(n) for n in ("pos", "depth", "a", "b", "words", "digest", "c0", "n_convs", "band", "path")])
    assert got(*prefix_trie.share_openings(prefix_trie.turns_of(frame))) == brute(rebuilt(ODD))
