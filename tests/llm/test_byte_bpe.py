import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from keystride.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.shared_bpe(RANKS, PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def ids_of(packed):
    return [int.from_bytes(packed[i:i + 4], "little") for i in range(0, len(packed), 4)]


ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\tx", "it's  they'll", "é̈ ñ b", "日本語 text", "😀😀 !",
       "a" * 3000, "ab " * 2000, "x  y", "0123456789 12 3", "\x1c a\x1db", "<|endoftext|>"]


def test_ids_are_those_of_the_rank_file(bpe, reference):
    assert [ids_of(p) for p in bpe.encode(ODD)] == [reference.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_any_text_encodes_alike_and_comes_back(bpe, reference, texts):
    for text, packed in zip(texts, bpe.encode(texts), strict=True):
        assert ids_of(packed) == reference.encode_ordinary(text)
        assert bpe.decode(ids_of(packed)) == text.encode()


def test_offsets_name_the_character_of_each_token(bpe):
    text = "añ 😀 b"
    ids = ids_of(bpe.encode([text])[0])
    starts = bpe.starts(text, ids)
    assert len(starts) == len(ids) and starts == sorted(starts) and starts[0] == 0
    assert bpe.starts("", []) == []


def test_split_characters_decode_to_the_replacement(spark, bpe):
    ids = ids_of(bpe.encode(["\U0001F9EC"])[0])
    assert len(ids) > 1
    rows = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, []), (4, None)], "doc_id bigint, ids array<int>")
    got = {r.doc_id: (bytes(r.bytes), r.text) for r in byte_bpe.decode(rows, RANKS, PATTERN).collect()}
    assert got[1] == ("\U0001F9EC".encode(), "\U0001F9EC")
    assert got[2][1] == "�" and got[3] == (b"", "") and got[4] == (b"", "")


def test_digests_of_null_empty_and_repeated_rows(docs, spark):
    frame = docs((1, None), (1, ""), (2, "the end"), (2, "the end"), (None, "x"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in byte_bpe.digests(frame, RANKS, PATTERN, ["doc_id"]).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1:3] == [(1, 0, empty, empty)] * 2
    assert got[3] == got[4] and got[3][3] == hashlib.sha256(b"the end").hexdigest()
    assert byte_bpe.digests(frame.limit(0), RANKS, PATTERN, ["doc_id"]).count() == 0


def test_offsets_column_and_clashing_names(docs):
    frame = docs((1, "a b")).withColumnRenamed("source", "ids_")
    out = byte_bpe.encode(frame, RANKS, PATTERN, keep=["doc_id", "ids_"], offsets=True)
    assert out.columns == ["doc_id", "ids_", "ids", "offsets"]
    assert out.first().offsets == [0, 1]
