"""Token ids in Arrow IPC files of equal-length sequences with masks, read back by memory map.

``write`` sorts documents by id into ranges; each task encodes its range and writes one shard: an
Arrow IPC file whose record batches hold ``batch`` sequences as fixed-size lists (``ids`` of
``length`` integers, ``mask`` of as many bits, packed into bytes), and an index file with the place of each document
in the shard's stream. Every batch but a shard's last has the same number of sequences, so sequence
``i`` is row ``i % batch`` of batch ``i // batch`` and is read without copying. The last sequence of a
shard is padded; its mask is false there.

File names carry the attempt, and the manifest, which Spark commits, names the attempts that count;
files of lost or repeated attempts are never read. ``path`` may be any URI that
``pyarrow.fs.FileSystem.from_uri`` opens.

Order: ascending id (nulls first), then the hash of the text, then the text. Null and empty texts
have the end id alone. The tokenizer is used as it is loaded: names of added tokens (``<|endoftext|>``) in
a text get their own ids; such texts go through the library whole. An empty table has a manifest without
rows.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keystride.llm.common import bound_batches, ship
from keystride.llm.part_memo import PartMemo, joined, split_texts
from keystride.session import materialize, work_dir

SEQUENCE_LENGTH = 2048
BATCH_SEQUENCES = 64
MEMO_WORDS = 200_000     # distinct words remembered by a worker, as many older ones and as many on trial

MANIFEST = "shard int, file string, index_file string, n_tokens bigint, n_sequences bigint, n_docs bigint"


class WordEncoder:
    """Encodes texts with a tokenizer whose pieces never span white space.

    Each distinct word that comes again is encoded once per worker, within a bounded memo. New words are
    cut into the pieces of the tokenizer's own pattern where that is safe (``_cutter``); the pieces not met
    before go to the library's model in one call, and the ends of words among the ids tell them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        # A text that holds one of these, in whatever case, is not encoded word by word.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        made = json.loads(self.library.to_str())
        self.cut = self._cutter(made)
        if self.cut:
            # Pieces are in their normal form already, so this one only turns bytes into ids.
            made.update(normalizer=None, added_tokens=[], pre_tokenizer={
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False})
            self.model = Tokenizer.from_str(json.dumps(made))
            suffix = made["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
            for name, i in made["model"]["vocab"].items():
                self.ends[i] = name.endswith(suffix)
        self.memo = PartMemo(self._encode_words, MEMO_WORDS)
        self.pieces = PartMemo(self._encode_pieces, MEMO_WORDS)

    @staticmethod
    def _cutter(made: dict) -> Callable[[str], list[str]] | None:
        """What cuts a word into pieces, if pieces are the matches of a pattern in lower-cased text."""
        def steps(part, inner):
            return (part or {}).get(inner) or [part or {}]

        forms, cuts = steps(made["normalizer"], "normalizers"), steps(made["pre_tokenizer"], "pretokenizers")
        first = cuts[0]
        plain = ([f.get("type") for f in forms] == ["NFC", "Replace", "Lowercase"] and forms[1]["pattern"] == {"Regex": r"\s+"}
                 and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
                 and made["model"].get("end_of_word_suffix")
                 and all(c.get("type") == "ByteLevel" and not c["use_regex"] and not c["add_prefix_space"] for c in cuts[1:]))
        return regex.compile(first["pattern"]["Regex"]).findall if plain else None

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.type).tobytes()

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.model.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=self.type)
        size, packed = self.type.itemsize, ids.tobytes()
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
        return [packed[i:j] for i, j in zip([0, *stops], stops)]

    def _pieces(self, word: str) -> list[str] | tuple[str, ...] | None:
        """The pieces of a word, or None if the library must see the word itself."""
        if self.cut is None:
            return None
        if word.isascii() and word.isalpha():
            return (word.lower(),)
        # Below U+0250 letters and their normal forms are the same to all versions of Unicode.
        return self.cut(word.lower()) if word.isprintable() and max(word, default="") < "\u0250" else None

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        cut = list(map(self._pieces, words))
        known = self.pieces.values(set(chain.from_iterable(c for c in cut if c is not None)))
        others = iter(self._encode_each([w for w, c in zip(words, cut, strict=True) if c is None]))
        return (next(others) if c is None else known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cut)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes | memoryview]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # All white space ends a word and is dropped; what is left in a part is the library's affair.
        parts, bounds = split_texts(pc.replace_substring(texts, "\n", " "))
        codes, values = self.memo.lookup(parts)
        out = joined(values, codes, bounds)
        held = np.zeros(len(texts), dtype=bool)
        for name in self.added:
            held |= pc.match_substring(texts, name, ignore_case=True).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(held).tolist()
        for i, packed in zip(whole, self._encode_each([texts[i].as_py() for i in whole]), strict=True):
            out[i] = packed
        return out


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(path)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class ShardWriter:
    """Cuts a stream of ids into sequences and writes full batches as they come."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int, batch: int):
        store, place = open_store(folder)
        store.create_dir(place, recursive=True)
        stem = f"{place}/shard-{shard:05d}-{uuid.uuid4().hex}"
        self.files = f"{stem}.arrow", f"{stem}.index.arrow"
        self.length, self.batch, self.dtype = length, batch, dtype
        ids, mask = pa.list_(pa.from_numpy_dtype(dtype), length), pa.list_(pa.uint8(), -(-length // 8))
        self.schema = pa.schema([("ids", ids), ("mask", mask)])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [store.open_output_stream(f) for f in self.files]
        self.out = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.rest, self.waiting = [], 0
        self.tokens = self.docs = self.sequences = 0

    def _put(self, stream: np.ndarray) -> None:
        n = -(-len(stream) // self.length)
        padded = np.zeros(n * self.length, dtype=self.dtype)
        padded[:len(stream)] = stream
        real = np.packbits((np.arange(n * self.length) < len(stream)).reshape(n, -1), axis=1)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), k) for a, k in ((padded, self.length), (real, real.shape[1]))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += n

    def add(self, doc_ids: pa.Array, encoded: list[bytes]) -> None:
        sizes = np.array([len(e) // self.dtype.itemsize for e in encoded], dtype=np.int64)
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays(
            [doc_ids.cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.rest.append(np.frombuffer(b"".join(encoded), dtype=self.dtype))
        added = int(sizes.sum())
        self.tokens, self.docs, self.waiting = self.tokens + added, self.docs + len(encoded), self.waiting + added
        full = self.length * self.batch
        if self.waiting >= full:
            stream = np.concatenate(self.rest)
            for i in range(0, len(stream) - full + 1, full):
                self._put(stream[i:i + full])
            self.rest = [stream[len(stream) // full * full:]]
            self.waiting = len(self.rest[0])

    def close(self) -> tuple:
        if self.waiting:
            self._put(np.concatenate(self.rest))
        for writer in (self.out, self.index, *self.sinks):
            writer.close()
        return (*self.files, self.tokens, self.sequences, self.docs)


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
          length: int = SEQUENCE_LENGTH, batch: int = BATCH_SEQUENCES) -> DataFrame:
    """Write the files; returns the committed manifest, one row per shard."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # Hashes of texts let rows of one id be split; the texts themselves would be sampled to the driver.
    ranges = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(*ranges).sortWithinPartitions(*ranges, "text")
    ship(spark)
    bound_batches(spark)

    def run(batches):
        encoder, writer, shard = shared_encoder(tokenizer_path), None, TaskContext.get().partitionId()
        end = np.array([end_id], dtype=encoder.type).tobytes()
        for rows in batches:
            if rows.num_rows:
                writer = writer or ShardWriter(folder, shard, encoder.type, length, batch)
                writer.add(rows.column(0), [b"".join((e, end)) for e in encoder.encode(rows.column(1))])
        if writer:
            row = (shard, *writer.close())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3], strict=True)],
                names=["shard", "file", "index_file", "n_tokens", "n_sequences", "n_docs"])

    return materialize(placed.mapInArrow(run, MANIFEST))


def with_offsets(manifest: DataFrame) -> DataFrame:
    """Add ``first_token``, the ids in all shards before; one row per shard, so a single task will do."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _store_of(folder: str) -> fs.FileSystem:
    return open_store(folder)[0]


def open_tokens(store: fs.FileSystem, file: str) -> pa.ipc.RecordBatchFileReader:
    """A local file is memory-mapped; batches are then views of the file."""
    local = isinstance(store, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(file) if local else store.open_input_file(file))


def read_sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and packed mask of sequence ``i``, both views of the batch; ``unpack_mask`` spreads the mask."""
    size = reader.get_batch(0).num_rows
    rows = reader.get_batch(i // size)
    return tuple(rows.column(c)[i % size].values.to_numpy(zero_copy_only=True) for c in ("ids", "mask"))


def unpack_mask(packed: np.ndarray, length: int) -> np.ndarray:
    """A byte per position: 1 for a real token, 0 for padding."""
    return np.unpackbits(packed, count=length)


def read_sequences(manifest: DataFrame, folder: str) -> DataFrame:
    """``shard, sequence, ids array<bigint>, n_real`` of all files."""
    def run(batches):
        store = _store_of(folder)
        for rows in batches:
            for shard, file in zip(*(rows.column(c).to_pylist() for c in (0, 1)), strict=True):
                reader, at = open_tokens(store, file), 0
                for b in range(reader.num_record_batches):
                    got = reader.get_batch(b)
                    n = got.num_rows
                    real = np.unpackbits(got.column("mask").flatten().to_numpy().reshape(n, -1), axis=1).sum(axis=1, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()),
                         got.column("ids").cast(pa.list_(pa.int64())), pa.array(real, pa.int64())],
                        names=["shard", "sequence", "ids", "n_real"])
                    at += n

    ship(manifest.sparkSession)
    return manifest.select("shard", "file").mapInArrow(run, "shard int, sequence bigint, ids array<bigint>, n_real bigint")


def _stream(reader: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    for b in range(reader.num_record_batches):
        yield reader.get_batch(b).column("ids").flatten().to_numpy()


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    A shard is streamed batch by batch; the document that spans several is gathered.
    """
    n = max(1, manifest.count())
    shards = with_offsets(manifest).select("first_token", "file", "index_file").repartition(n)

    def documents(store, file, index_file):
        stream, part, at = _stream(open_tokens(store, file)), np.empty(0, dtype=np.uint32), 0
        index = open_tokens(store, index_file)
        for b in range(index.num_record_batches):
            rows = index.get_batch(b)
            sizes, sums = rows.column("n_tokens").to_numpy(), []
            for size in sizes:
                crc, left = 0, int(size)
                while True:
                    take = part[at:at + left]
                    crc = zlib.crc32(np.ascontiguousarray(take, dtype="<u4"), crc)
                    at, left = at + len(take), left - len(take)
                    if not left:
                        break
                    part, at = next(stream), 0
                sums.append(crc)
            yield rows.column("doc_id"), rows.column("start").to_numpy(), sizes, sums

    def run(batches):
        store = _store_of(folder)
        for rows in batches:
            for first, file, index_file in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                for ids, starts, sizes, sums in documents(store, file, index_file):
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(starts + first), pa.array(sizes), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(manifest.sparkSession)
    return shards.mapInArrow(run, T.StructType.fromDDL("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def new_folder(spark) -> str:
    return work_dir(spark, "token-files")
