import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keystride.llm import token_alignment
from keystride.llm.part_memo import PartMemo

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.shared_aligner(A, B)


def spans(sizes):
    at, out = 0, []
    for s in sizes:
        out.append((at, at := at + s))
    return out


def brute_one(libraries, text):
    """Groups, links of one text by comparing every pair of spans; whole texts through the plain libraries."""
    a, b = libraries
    if not text:
        return "", []
    visible = {}
    spare = 256
    for i in range(256):
        shown = 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i <= 255
        visible[chr(i if shown else spare)] = i
        spare += not shown
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(visible[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return "", []
    spans_a, spans_b = spans(map(len, bytes_a)), spans(map(len, bytes_b))
    cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups, low = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, sp) if low < e <= cut)
                               for ids, sp in ((ids_a, spans_a), (ids_b, spans_b))))
        low = cut
    pairs = [(x, y) for x, (s, e) in zip(ids_a, spans_a) for y, (t, f) in zip(ids_b, spans_b) if s < f and t < e]
    return ";".join(groups), pairs


def brute(libraries, rows):
    found = [(i, *brute_one(libraries, t)) for i, t in rows]
    counts = Counter(p for _, _, pairs in found for p in pairs)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, groups, pairs in found:
        sides = [g.split("|") for g in groups.split(";")] if groups else []
        out.append((i, *(sum(len(s[k].split(",")) for s in sides) for k in (0, 1)), len(sides), len(pairs),
                    sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                    hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def got(frame, **how):
    return sorted((tuple(r) for r in token_alignment.alignment(frame, A, B, ["doc_id"], **how).select("doc_id", *NAMES).collect()), key=repr)


TEXTS = [None, "", " ", "  ", "a", "hello world", "Hello  wide   world ", " lead", "tab\there\nand\r\n line\n\nbreaks", "▁", "a ▁ b", "a▁b",
         "<s> </s> <unk> <0x41> <|endoftext|>", "日本語 のテキスト 😀👩‍👩‍👧", "naïve café é", "x" * 700, "don't they'll we've", "a\x00b", "a\x1cb \x1c c",
         "1234567 89,012.50", "hello world", "nbsp here  em", "﻿bom", "antidisestablishmentarianism internationalisation", "\n", "a\n", "word " * 300]


def test_odd_texts(docs, libraries):
    rows = [*enumerate(TEXTS), (5, "hello world"), (None, "hello there")]
    assert got(docs(*rows)) == brute(libraries, rows)


def test_small_table_with_both_joins(small, libraries):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    want = brute(libraries, rows)
    assert got(small("documents")) == want
    assert got(small("documents"), max_broadcast=0) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_any_text_aligns_as_span_by_span(aligner, libraries, texts):
    for text, (n_a, n_b, n_groups, spelling, keys) in zip(texts, aligner.align(pa.array(texts, pa.string())), strict=True):
        groups, pairs = brute_one(libraries, text)
        assert bytes(spelling).decode() == groups
        assert sorted(keys.tolist()) == sorted(x * 32000 + y for x, y in pairs)
        assert n_a + n_b - n_groups == len(pairs)


def test_empty_texts_between_others_have_no_tokens():
    texts = ["0 1", None, "fig", "", "1 2"]
    found = list(token_alignment.Aligner(A, B).align(pa.array(texts, pa.string())))
    assert [(n_a, n_b, n_groups, bytes(spelling), len(keys)) for n_a, n_b, n_groups, spelling, keys in found[1::2]] == 2 * [(0, 0, 0, b"", 0)]
    assert all(n_a for n_a, *_ in found[::2])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the", "cat", "'s", "it's", "zzyzx", "\n\nThe", "café", "a▁", "...", "(x)", "<0x0A>", "10", "\tq"]), max_size=30))
def test_texts_of_known_parts(aligner, libraries, words):
    text = " ".join(words)
    ((*_, spelling, _),) = aligner.align(pa.array([text]))
    assert bytes(spelling).decode() == brute_one(libraries, text)[0]


def test_empty_table_and_clashing_names(docs):
    assert got(docs()) == []
    frame = docs((1, "a b")).select("doc_id", "text", *[F.lit(9).alias(n) for n in ("pairs", "times", "uid", "n_a", "count", "keep0")])
    kept = token_alignment.alignment(frame, A, B, ["doc_id", "uid", "pairs", "keep0"]).collect()
    assert [(r.doc_id, r.uid, r.pairs, r.keep0, r.n_a) for r in kept] == [(1, 9, 9, 9, 2)]


def test_groups_are_spelled_out(docs):
    row = token_alignment.align(docs((1, "hello wide world")), A, B, ["doc_id"], groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert row.groups.count(";") == row.n_groups - 1


def test_memo_keeps_parts_that_come_again_and_stays_bounded():
    computed = []
    memo = PartMemo(lambda parts: [computed.append(p) or p.upper() for p in parts], most=10, longest=5)
    for turn in range(50):
        parts = {"hot", "warm", "toolong", *(f"j{turn}{i}" for i in range(4))}
        assert memo.values(parts) == {p: p.upper() for p in parts}
        assert len(memo.known) + len(memo.old) + len(memo.fresh) <= 40
    assert computed.count("hot") <= 2 and computed.count("toolong") == 50
    many = [f"w{i}" for i in range(25)]
    for _ in range(30):
        for some in (many[:9], many[8:17], many[16:]):
            assert memo.values(some) == {p: p.upper() for p in some}
    assert computed.count("hot") <= 2 and computed.count("w3") <= 30
