import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keystride.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def expected(library, rows):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(text) + [1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def read_back(frame, folder, **options):
    manifest = token_files.write(frame, PATH, folder, 1, **options)
    rows = [tuple(r) for r in token_files.read_documents(manifest, folder).collect()]
    return manifest, sorted(rows, key=lambda r: r[1])


TEXTS = [(5, "The end of It"), (2, None), (9, ""), (7, "a\x1cb c\x1dd"), (3, "é́ ΣΑΣ İx"), (4, "word " * 5000), (6, "it's 12 !!")]


def test_round_trip_equals_the_library(docs, library, tmp_path):
    manifest, rows = read_back(docs(*TEXTS), str(tmp_path / "a"), length=16, batch=4)
    assert rows == expected(library, TEXTS)
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == sum(r[2] for r in rows)


def test_small_tables(small, library, tmp_path):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    assert read_back(small("documents"), str(tmp_path / "b"))[1] == expected(library, rows)


def test_sequences_have_one_length_and_true_masks(docs, tmp_path):
    folder = str(tmp_path / "c")
    manifest = token_files.write(docs(*TEXTS), PATH, folder, 1, length=16, batch=4)
    sizes = {r.shard: r.n_tokens for r in manifest.collect()}
    seen = token_files.read_sequences(manifest, folder).collect()
    assert {len(r.ids) for r in seen} == {16}
    for shard, n in sizes.items():
        assert sum(r.n_real for r in seen if r.shard == shard) == n


def test_random_access_is_a_view(docs, tmp_path):
    folder = str(tmp_path / "d")
    manifest = token_files.write(docs(*TEXTS).coalesce(1), PATH, folder, 1, length=16, batch=4)
    store = token_files.open_store(folder)[0]
    for r in manifest.collect():
        reader = token_files.open_tokens(store, r.file)
        got = [token_files.read_sequence(reader, i) for i in range(r.n_sequences)]
        stream = np.concatenate([ids for ids, _ in got])
        masks = np.concatenate([token_files.unpack_mask(packed, 16) for _, packed in got])
        assert masks[:r.n_tokens].all() and not masks[r.n_tokens:].any() and len(stream) == 16 * r.n_sequences
        # Both lie in the mapped file itself: no batch and no mask is copied.
        with pa.memory_map(r.file) as mapped:
            whole = np.frombuffer(mapped.read_buffer(), dtype=np.uint8)
            reader = pa.ipc.open_file(mapped)
            for i in range(r.n_sequences):
                assert all(np.shares_memory(whole, x) for x in token_files.read_sequence(reader, i))


def test_added_tokens_have_the_ids_the_library_gives_them(library):
    texts = ["a<|endoftext|>b <|startoftext|> c", "<|ENDOFTEXT|> x", "<|endoftext|>", "a\x1cb c\x85d e\u00a0f", "Ünï ÇÖ&&x,. 1a2's\n\nb"]
    encoder = token_files.shared_encoder(PATH)
    assert [np.frombuffer(e, encoder.type).tolist() for e in encoder.encode(texts)] == [library(t) for t in texts]
    assert len(library(texts[0])) == 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_any_text_encodes_alike(library, texts):
    encoder = token_files.shared_encoder(PATH)
    assert [np.frombuffer(e, encoder.type).tolist() for e in encoder.encode(texts)] == [library(t) for t in texts]


def test_clashing_names(docs, tmp_path):
    frame = docs((1, "a b"), (2, "c")).select("doc_id", "text", *[F.lit(9).alias(n) for n in ("start", "n_tokens", "shard", "ids", "file")])
    assert [r[:3] for r in read_back(frame, str(tmp_path / "g"))[1]] == [(1, 0, 3), (2, 3, 2)]


def test_repeated_rows_null_ids_and_empty_table(docs, library, tmp_path):
    rows = [(1, "x y"), (1, "x y"), (1, "z"), (None, "n")]
    _, got = read_back(docs(*rows), str(tmp_path / "e"))
    assert [r[0] for r in got] == [None, 1, 1, 1] and got[-1][1] + got[-1][2] == sum(len(library(t)) + 1 for _, t in rows)
    assert read_back(docs(*rows).limit(0), str(tmp_path / "f"))[1] == []
