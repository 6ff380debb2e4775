"""Byte-level BPE with the tokenizers library: encode to ids and offsets, decode to bytes and text.

A rank file lists tokens as bytes with their ranks; joining two neighbours is allowed whenever their
bytes together are a token, and the lowest rank goes first. The library works on characters, so each
byte stands for a character of its own (``byte_characters``), and every split of a token into two
tokens becomes a merge, in the order of the ranks.

Pieces are independent, so texts are cut at single spaces between other characters, which are always
piece boundaries, and each distinct part that comes again is encoded once per worker (a bounded memo).
The pieces of all new parts of a batch go to the library in one call and their ids are told apart by the
bytes they stand for. A text with any other run of spaces is matched whole against the pattern.

Null and empty texts have no ids. Rows are kept one by one, repeated ones too. Ids outside the
vocabulary are an error. A character cut by the end of an id list decodes to U+FFFD in ``text``;
``bytes`` are exact.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.llm.common import map_columns
from keystride.llm.part_memo import PartMemo, any_of, joined, split_texts

MEMO_PARTS = 150_000     # distinct parts remembered by a worker, as many older ones and as many on trial
NOT_ALONE = b"?"         # stands for the ids of a part that cannot be encoded by itself


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    table, spare = [], 256
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        table.append(chr(b if shown else spare))
        spare += not shown
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = read_ranks(ranks_path)
        self.pieces = regex.compile(pattern)
        self.token_bytes = {r: t for t, r in self.ranks.items()}
        self.sizes = np.zeros(max(self.token_bytes, default=0) + 1, dtype=np.int64)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        self.first = PartMemo(lambda parts: self._encode_parts(parts, ""), MEMO_PARTS // 8)
        self.rest = PartMemo(lambda parts: self._encode_parts(parts, " "), MEMO_PARTS)

    @functools.cached_property
    def byte_table(self) -> pa.Array:
        """The bytes of each id, empty where there is none."""
        return pa.array([self.token_bytes.get(i, b"") for i in range(len(self.sizes))], pa.large_binary())

    @functools.cached_property
    def library(self):
        """Built for encoding only; decoding reads the byte table."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, shown = self.ranks, byte_characters()
        spell = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            cuts = sorted((ranks[a], ranks[b], a, b) for a, b in cuts if a in ranks and b in ranks)
            merges += [(spell[a], spell[b]) for _, _, a, b in cuts]
        # A piece that is a token as it stands needs no merges.
        made = Tokenizer(models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return made

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, none of them empty, by one call of the library."""
        if not pieces:
            return {}
        ids = np.array(self.library.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(ends, list(accumulate(len(p.encode()) for p in pieces)), side="right") * 4
        packed = ids.tobytes()
        return {p: packed[i:j] for p, i, j in zip(pieces, (0, *cuts[:-1].tolist()), cuts.tolist(), strict=True)}

    def _encode_parts(self, parts: list[str], lead: str) -> Iterator[bytes]:
        """Ids of parts after ``lead``. A cut beside another space is no piece boundary: such a part cannot stand alone."""
        alone = [bool(p) and not p[0].isspace() and not p[-1].isspace() for p in parts]
        found = [self.pieces.findall(lead + p) if a else () for p, a in zip(parts, alone, strict=True)]
        known = self._encode_pieces(list(dict.fromkeys(x for f in found for x in f)))
        for a, f in zip(alone, found, strict=True):
            yield b"".join([known[x] for x in f]) if a else NOT_ALONE

    def _encode_whole(self, text: str) -> bytes:
        found = self.pieces.findall(text)
        known = self._encode_pieces(list(dict.fromkeys(found)))
        return b"".join(map(known.__getitem__, found))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts, bounds = split_texts(texts)
        # The first part of a text has no space before it.
        tail = np.ones(len(parts), dtype=bool)
        tail[bounds[:-1]] = False
        codes, values = self.rest.lookup(parts.filter(pa.array(tail)))
        tails = bounds - np.arange(len(bounds))
        whole = any_of(np.array([v == NOT_ALONE for v in values], dtype=bool)[codes], tails)
        heads, head_values = self.first.lookup(parts.take(pa.array(bounds[:-1])))
        out = []
        for i, (head, rest) in enumerate(zip(heads.tolist(), joined(values, codes, tails), strict=True)):
            if whole[i] or head_values[head] == NOT_ALONE:
                text = texts[i].as_py()
                out.append(self._encode_whole(text) if text else b"")
            else:
                out.append(head_values[head] + rest)
        return out

    def starts(self, text: str, ids: list[int]) -> list[int]:
        """Character offset at which each token starts; a token inside a character gets that character."""
        of_byte = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text])
        ends = np.cumsum([0] + [len(self.token_bytes[i]) for i in ids])[:-1]
        return of_byte[ends].tolist() if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_lists(self, lists: pa.Array) -> pa.Array:
        """The bytes of each list of ids: one look-up of all ids, whose bytes then lie side by side."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < len(self.sizes))
        if not known.all() or not self.sizes[ids].all():
            raise ValueError("ids outside the vocabulary")
        taken = self.byte_table.take(pa.array(ids))
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        offsets = pa.py_buffer(np.ascontiguousarray(ends, dtype=np.int64))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, offsets, taken.buffers()[2]]).cast(pa.binary())


@functools.lru_cache(maxsize=2)
def shared_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    """One per worker process, so that later tasks find its memo filled."""
    return ByteBpe(ranks_path, pattern)


def _id_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None,
           offsets: bool = False) -> DataFrame:
    """Kept columns, ``ids array<int>`` and, if asked for, ``offsets array<int>``."""
    def make():
        bpe = shared_bpe(ranks_path, pattern)

        def compute(texts: pa.Array) -> list[pa.Array]:
            out = bpe.encode(texts)
            columns = [_id_lists(out)]
            if offsets:
                starts = [bpe.starts(t.as_py() or "", np.frombuffer(p, "<u4").tolist()) for t, p in zip(texts, out, strict=True)]
                columns.append(pa.array(starts, pa.list_(pa.int32())))
            return columns

        return compute

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    added = "ids array<int>" + (", offsets array<int>" if offsets else "")
    return map_columns(docs, [F.col(f"`{text}`").cast("string")], keep, added, make)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None,
           text: bool = True) -> DataFrame:
    """Kept columns, ``bytes binary`` and, if asked for, ``text string``."""
    def make():
        bpe = shared_bpe(ranks_path, pattern)

        def compute(lists: pa.Array) -> list[pa.Array]:
            back = bpe.decode_lists(lists)
            return [back] + ([pa.array([b.as_py().decode("utf-8", "replace") for b in back], pa.string())] if text else [])

        return compute

    keep = [c for c in encoded.columns if c != ids] if keep is None else keep
    return map_columns(encoded, [F.col(f"`{ids}`")], keep, "bytes binary" + (", text string" if text else ""), make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass: kept columns, ``ids array<int>`` and ``bytes binary``."""
    def make():
        bpe = shared_bpe(ranks_path, pattern)

        def compute(texts: pa.Array) -> list[pa.Array]:
            ids = _id_lists(bpe.encode(texts))
            return [ids, bpe.decode_lists(ids)]

        return compute

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    return map_columns(docs, [F.col(f"`{text}`").cast("string")], keep, "ids array<int>, bytes binary", make)


def digests(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again, and reduce both to digests; kept columns come first."""
    decoded = round_trip(docs, ranks_path, pattern, keep=keep)
    return decoded.select(
        *[F.col(f"`{c}`") for c in keep], F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"), *(["ids"] if with_ids else []),
    )
