"""Alignment of two tokenizers' tokens by the bytes they cover.

A space and the text are encoded by a byte-level BPE (A) and by a piece model (B, which puts the space
itself). Token ends are counted in bytes and kept in one dictionary a side, from end to place. The ends
in both dictionaries, sorted, slice the two id lists into groups; within a group no inner end is common,
so its tokens are linked along both lists by whichever ends first. Links join all pairs of tokens whose
byte ranges overlap.

A text is cut at single spaces between other characters, which end a token on both sides, and each
distinct part is aligned once per worker within a bounded memo; the model is checked for pieces that
would span such a cut. Texts with other runs of spaces are aligned whole, however long.

Corpus statistics: ``pair_counts`` sums how often two ids are linked over all texts. The counts are met
with each text's pairs where they lie if a counted bound lets the table be broadcast, by a shuffled
join beyond it.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens.
Rows are kept one by one, repeated ones and null ids too. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride.llm.byte_bpe import byte_characters
from keystride.llm.common import map_columns, meet
from keystride.llm.part_memo import PartMemo, any_of, joined, split_texts
from keystride.session import materialize

MEMO_PARTS = 150_000
CHUNK_CHARACTERS = 1 << 14   # new parts are encoded together in texts of about this length
BROADCAST_PAIRS = 2_000_000  # rows of two integers and a flag, 40 bytes each in a worker's table
# How the piece model spells a space and a byte.
SPACE_SIGN, BYTE_PIECE = "▁", "<0x{:02X}>"

# Of one part or text: tokens of A, of B, groups, their spelling, keys of linked pairs as 64-bit integers.
Aligned = tuple[int, int, int, bytes, bytes]
NOTHING: Aligned = (0, 0, 0, b"", b"")  # a part whose bytes do not come back
# A space beside white space, white space at an end of the text, or no text: an empty part would be a space between others.
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_NO_CUT = rf"{_WHITE} | {_WHITE}|\A{_WHITE}|{_WHITE}\z|\A\z"


def slices(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """``end, a_from, a_to, b_from, b_to`` of each group, from ascending token ends."""
    place_a = dict(zip(ends_a, range(1, len(ends_a) + 1), strict=True))
    place_b = dict(zip(ends_b, range(1, len(ends_b) + 1), strict=True))
    a = b = 0
    for end in sorted(place_a.keys() & place_b.keys()):
        to_a, to_b = place_a[end], place_b[end]
        yield end, a, to_a, b, to_b
        a, b = to_a, to_b


def links(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int]]:
    """Places of overlapping tokens of one group, whose lists end together."""
    i = j = 0
    while True:
        yield i, j
        if ends_a[i] < ends_b[j]:
            i += 1
        elif ends_b[j] < ends_a[i]:
            j += 1
        else:
            return


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = {c: i for i, c in enumerate(byte_characters())}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(of.__getitem__, n)) for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        raw = {BYTE_PIECE.format(i): bytes([i]) for i in range(256)}
        self.b_bytes = [raw[p] if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
        self.a_size, self.b_size = (list(map(len, t)) for t in (self.a_bytes, self.b_bytes))
        self.spelled = [b"%d" % i for i in range(max(len(names), len(pieces)))]
        self.memo = PartMemo(self._align_parts, MEMO_PARTS)

    def _encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space and text, or None if either side does not give back its bytes."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        whole = b" " + text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else None

    def _align(self, text: str, parts: int = 1) -> list[Aligned] | None:
        """A value for each of ``parts`` parts of ``text``, between single spaces; None if it has no tokens."""
        ids = self._encoded(text) if text else None
        if ids is None:
            return None
        a, b = ids
        ends_a, ends_b = (list(accumulate(map(size.__getitem__, x))) for x, size in ((a, self.a_size), (b, self.b_size)))
        spell_a, spell_b = (list(map(self.spelled.__getitem__, x)) for x in ids)
        out, groups, pairs, width = [], [], [], len(self.b_size)
        sizes = (len(p) + 1 if p.isascii() else len(p.encode()) + 1 for p in text.split(" ")) if parts > 1 else ends_a[-1:]
        part_ends = accumulate(sizes)
        part_end, a_start, b_start = next(part_ends), 0, 0
        for end, a0, a1, b0, b1 in slices(ends_a, ends_b):
            if a1 - a0 == 1 == b1 - b0:
                groups.append(spell_a[a0] + b"|" + spell_b[b0])
                pairs.append(a[a0] * width + b[b0])
            else:
                groups.append(b",".join(spell_a[a0:a1]) + b"|" + b",".join(spell_b[b0:b1]))
                pairs += [a[a0 + i] * width + b[b0 + j] for i, j in links(ends_a[a0:a1], ends_b[b0:b1])]
            if end == part_end:
                out.append((a1 - a_start, b1 - b_start, len(groups), b";".join(groups) + b";", array("q", pairs).tobytes()))
                groups, pairs, a_start, b_start, part_end = [], [], a1, b1, next(part_ends, None)
        return out

    def _align_parts(self, parts: list[str]) -> Iterator[Aligned]:
        """New parts are encoded many at a time."""
        start = 0
        while start < len(parts):
            stop, length = start, 0
            while stop < len(parts) and length < CHUNK_CHARACTERS:
                length += len(parts[stop]) + 1
                stop += 1
            chunk = parts[start:stop]
            together = self._align(" ".join(chunk), len(chunk))
            if together is not None and len(together) == len(chunk):
                yield from together
            else:  # some part's bytes do not come back
                yield from ((self._align(p) or [NOTHING])[0] for p in chunk)
            start = stop

    def align(self, texts: pa.Array) -> Iterator[tuple[int, int, int, memoryview | bytes, np.ndarray]]:
        """Tokens of A and B, groups, their spelling and the keys of all links of each text; zeros without tokens."""
        parts, bounds = split_texts(texts)
        whole = pc.match_substring_regex(pc.fill_null(texts, ""), _NO_CUT).to_numpy(zero_copy_only=False)
        whole = whole if self.cuts else np.ones(len(texts), dtype=bool)
        alone = np.repeat(~whole, np.diff(bounds))
        codes, values = self.memo.lookup(parts.filter(pa.array(alone)))
        bounds = np.concatenate([[0], np.cumsum(alone)])[bounds]
        numbers = np.array([v[:3] for v in values] or [(0, 0, 0)], dtype=np.int64)
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(numbers[codes], axis=0)])[bounds]
        sums = np.diff(sums, axis=0).tolist()
        lost = any_of(np.array([v == NOTHING for v in values], dtype=bool)[codes], bounds)
        spelled, pairs = (joined([v[k] for v in values], codes, bounds) for k in (3, 4))
        for i, text in enumerate(texts):
            if whole[i]:
                n_a, n_b, n_groups, spelling, keys = (self._align(text.as_py()) or [NOTHING])[0]
            elif lost[i] or not sums[i][0]:
                n_a, n_b, n_groups, spelling, keys = NOTHING
            else:
                (n_a, n_b, n_groups), spelling, keys = sums[i], spelled[i], pairs[i]
            yield n_a, n_b, n_groups, spelling[:-1], np.frombuffer(keys, dtype=np.int64)


@functools.lru_cache(maxsize=2)
def shared_aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_path, b_path)


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text", groups: bool = False) -> DataFrame:
    """Kept columns, counts, digest of the groups, and the distinct linked pairs with how often they occur.

    A pair's key is ``a * vocabulary of B + b``. With ``groups`` the spelled-out groups are the last column.
    """
    def make():
        aligner = shared_aligner(a_path, b_path)

        def compute(texts: pa.Array) -> list[pa.Array]:
            counts, digests, spelled, flat, times, bounds = [], [], [], [], [], [0]
            for n_a, n_b, n_groups, spelling, links in aligner.align(texts):
                keys, often = np.unique(links, return_counts=True)
                counts.append((n_a, n_b, n_groups, len(links)))
                digests.append(hashlib.sha256(spelling).hexdigest() if n_a else "")
                if groups:
                    spelled.append(bytes(spelling).decode())
                flat.append(keys)
                times.append(often.astype(np.int32))
                bounds.append(bounds[-1] + len(keys))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(v))) for v in (flat, times)]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] + [pa.array(digests), *lists]
            return columns + ([pa.array(spelled)] if groups else [])

        return compute

    added = ALIGNED + (", groups string" if groups else "")
    return map_columns(docs, [F.col(f"`{text}`").cast("string")], keep, added, make)


def _pairs(aligned: DataFrame, *keep: str | Column) -> DataFrame:
    return aligned.select(*keep, F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")


def pair_counts(aligned: DataFrame, b_vocabulary: int) -> DataFrame:
    """``pair, count, is_best``: links of each pair in the corpus; the best of a B id have its highest count."""
    counted = materialize(_pairs(aligned).groupBy("pair").agg(F.sum("times").alias("count")))
    b_id = (F.col("pair") % b_vocabulary).cast("int").alias("b")
    highest = counted.groupBy(b_id).agg(F.max("count").alias("highest"))  # at most the vocabulary
    return materialize(counted.withColumn("b", b_id).join(F.broadcast(highest), "b").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("is_best")))


def alignment(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text",
              max_broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """Kept columns, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` are the links whose pair is a best of its B id in the corpus, ``count_sum`` adds up the
    corpus counts over all links.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    named = docs.select(*[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    aligned = align(named, a_path, b_path, named.columns[:-1])
    aligned = materialize(aligned.withColumn("uid", F.monotonically_increasing_id()))
    met = meet(_pairs(aligned, "uid"), pair_counts(aligned, width), ["pair"], max_broadcast=max_broadcast)
    sums = met.groupBy("uid").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
                                  F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return aligned.join(sums, "uid", "left").select(
        *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
