"""Token-id output: shard files of documents compressed one by one under a shared zstandard dictionary."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretokens
from .shared import materialize, shared_dir, small_batches
from .textops import byte_places, spread, texts_of

END_ID = 2
SHARD_BYTES = 32 << 20
#: The dictionary is fitted to about so many documents (twice as many at most), chosen by a hash of the key.
SAMPLE_DOCS, DICTIONARY_BYTES, LEVEL = 2_000, 64 << 10, 3
#: Texts of the sample are no longer than this: a shared dictionary is for short documents, and the driver holds 64 MB at most.
SAMPLE_BYTES = 16 << 10
#: Tasks that read files back.
READERS = 1024
#: Distinct pre-tokens that a worker remembers; beyond, it forgets all and starts anew.
REMEMBERED = 1_000_000
#: New pre-tokens that the library gets in one text.
JOINED = 64
MAGIC = b"SVTOK01\n"
#: magic, dictionary hash, bytes of an id, documents, place of the index.
HEADER = struct.Struct("<8s32sBQQ")
#: key, place of the frame, ids of the document.
ENTRY = np.dtype([("key", "<i8"), ("null", "u1"), ("at", "<u8"), ("ids", "<u8")])


class Encoder:
    """Ids of texts, by the tokenizers library.  A pre-token's ids depend on it alone, so the library encodes each
    distinct one once and a batch's ids are put together from those."""

    def __init__(self, path: str) -> None:
        self.pre = pretokens.load(path)
        self.width = 2 if self.pre.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.mark, self.mark_id = self._separator()
        self._forget()

    def _separator(self) -> tuple[bytes, int]:
        """A special string, and its id, that the library takes out wherever it stands, alone and first of all: the one there
        is, not matched by its surroundings, and without an end that is its beginning.  Else none."""
        added = list(self.pre.tokenizer.get_added_tokens_decoder().items())
        if len(added) != 1:
            return b"", -1
        number, t = added[0]
        s = t.content.encode()
        plain = s and not (t.single_word or t.lstrip or t.rstrip or t.normalized) and not any(s.startswith(s[-k:]) for k in range(1, len(s)))
        return (s, number) if plain else (b"", -1)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used, self.off = np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 16, np.int64)
        self.sure = np.zeros(1 << 16, np.uint64)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has).  JOINED words go to the library as one text, with the separator between
        them: it encodes each as if alone, and a call for each word costs more than the word."""
        if self.mark:
            joined = [self.mark.join(words[x : x + JOINED]).decode() for x in range(0, len(words), JOINED)]
            ids = np.array([*chain.from_iterable([*e.ids, self.mark_id] for e in self.pre.tokenizer.encode_batch_fast(joined, add_special_tokens=False))], np.uint32)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) == len(words):
                return ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1
        coded = [e.ids for e in self.pre.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.array([len(c) for c in coded])
        return np.fromiter(chain.from_iterable(coded), np.uint32, sizes.sum()), sizes

    def _learn(self, hashes: list[int], sure: np.ndarray, words: list[bytes]) -> None:
        n = len(self.known)
        while n + len(sure) > len(self.sure):
            self.sure = np.concatenate([self.sure, np.zeros_like(self.sure)])
        self.sure[n : n + len(sure)] = sure
        for at in range(0, len(words), 1 << 14):
            ids, sizes = self._encoded(words[at : at + (1 << 14)])
            n = len(self.known) + at
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(sizes) >= len(self.off):
                self.off = np.concatenate([self.off, np.zeros_like(self.off)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.off[n + 1 : n + len(sizes) + 1] = self.used + np.cumsum(sizes)
            self.used += len(ids)
        self.known.update(zip(hashes, range(len(self.known), len(self.known) + len(hashes)), strict=True))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        _, begin, end, text = self.pre.cut(data, offsets)
        pos = byte_places(data)
        begin, end = pos[begin], pos[end]
        found, sure = self.pre.hashes(data, begin, end)
        u, first, which = np.unique(found, return_index=True, return_inverse=True)
        if len(self.known) + len(u) > REMEMBERED:
            self._forget()
        hashes = u.tolist()
        at = np.fromiter(map(self.known.get, hashes, repeat(-1)), np.int64, len(u))
        if len(new := np.flatnonzero(at < 0)):
            raw, a, b = data.tobytes(), begin[first[new]].tolist(), end[first[new]].tolist()
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(u[new].tolist(), sure[first[new]], [raw[x:y] for x, y in zip(a, b, strict=True)])
        at = at[which]
        size = self.off[at + 1] - self.off[at]
        owner, rank = spread(size)
        ids = self.flat[self.off[at][owner] + rank]
        counts = np.bincount(text, size, len(offsets) - 1).astype(np.int64)
        # A pre-token that shares its first hash with another, but not the second: the library encodes such texts.
        return self._special(data, offsets, ids, counts, set(text[self.sure[at] != sure].tolist()))

    def _special(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray, also: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts with special strings, which the library takes out before it cuts, it encodes itself, and `also` these."""
        raw = data.tobytes()
        if not also and not any(s.encode() in raw for s in self.pre.special):
            return ids, counts
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        parts = np.split(ids, np.cumsum(counts)[:-1])
        parts = [np.array(self.pre.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if k in also or any(s in t for s in self.pre.special) else p for k, (t, p) in enumerate(zip(texts, parts, strict=True))]
        return np.concatenate(parts), np.array([len(p) for p in parts])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _documents(path: str, column: pa.Array, end_id: int) -> list[np.ndarray]:
    e = encoder(path)
    data, offsets = texts_of(column)
    ids, counts = e(data, offsets)
    return [np.append(x, np.uint32(end_id)).astype(f"<u{e.width}") for x in np.split(ids, np.cumsum(counts)[:-1])]


def train_dictionary(docs: DataFrame, path: str, key: str, text: str, end_id: int = END_ID) -> bytes:
    """A dictionary fitted to the id arrays of at most SAMPLE_DOCS documents; b'' where there are too few to fit one."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))  # chosen by hash beside the scan: tasks send what is chosen alone
    sample = docs.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).filter(F.octet_length(text) <= SAMPLE_BYTES).select(text).limit(2 * SAMPLE_DOCS).collect()
    if not sample:
        return b""
    arrays = [x.tobytes() for x in _documents(path, pa.array([r[0] for r in sample], pa.string()), end_id)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, arrays)) // 10)), arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _dictionary_name(digest: bytes) -> str:
    return f"dictionary-{digest.hex()}.zstd"


def store_dictionary(folder: str, dictionary: bytes) -> None:
    """Write the dictionary beside the files, under the hash that each of them carries."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{_dictionary_name(hashlib.sha256(dictionary).digest())}") as out:
        out.write(dictionary)


class ShardWriter:
    """One file: header, frames, index.  It appears under its name only when whole."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int) -> None:
        self.store, base = _store(folder)
        self.path, self.part = f"{base}/{name}", f"{base}/.{name}.part"
        self.store.create_dir(base, recursive=True)
        self.out = self.store.open_output_stream(self.part)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_dict_id=False)
        self.hash, self.width, self.at, self.entries, self.tokens = hashlib.sha256(dictionary).digest(), width, 0, [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        frame = self.zip.compress(ids.tobytes())
        self.entries.append((key or 0, key is None, self.at, len(ids)))
        self.out.write(frame)
        self.at += len(frame)
        self.tokens += len(ids)

    def close(self) -> None:
        """The index and a footer close the file: a stream can't go back to its start."""
        self.out.write(np.array([*self.entries, (0, 0, self.at, 0)], ENTRY).tobytes())
        self.out.write(HEADER.pack(MAGIC, self.hash, self.width, len(self.entries), self.at))
        self.out.close()
        self.store.move(self.part, self.path)


class Shard:
    """Reads a file's documents one by one, each by its place in the index.  Without a dictionary given it takes the one beside
    the file."""

    def __init__(self, path: str, dictionary: bytes | None = None) -> None:
        store, base = _store(path)
        self.file = store.open_input_file(base)
        size = self.file.size()
        magic, used, self.width, self.docs, self.index = HEADER.unpack(self.file.read_at(HEADER.size, size - HEADER.size))
        if dictionary is None and magic == MAGIC:
            with store.open_input_file(f"{base.rsplit('/', 1)[0]}/{_dictionary_name(used)}") as f:
                dictionary = f.read()
        if magic != MAGIC or used != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not of this format, or written with another dictionary")
        self.entries = np.frombuffer(self.file.read_at((self.docs + 1) * ENTRY.itemsize, self.index), ENTRY)
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def key(self, k: int) -> int | None:
        return None if self.entries["null"][k] else int(self.entries["key"][k])

    def ids(self, k: int) -> np.ndarray:
        a, b = int(self.entries["at"][k]), int(self.entries["at"][k + 1])
        ids = self.unzip.decompress(self.file.read_at(b - a, a), max_output_size=int(self.entries["ids"][k]) * self.width)
        return np.frombuffer(ids, f"<u{self.width}").astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, bytes]:
    """Write the ids of every document's whole text, `end_id` after each, in ascending order of the (integer) key.

    Texts are dealt by ranges of the key, sorted there, encoded and written in files of about `shard_bytes`; a retried
    task writes files of its own names, and only a task that succeeds has its files in the manifest.  Returns the
    manifest (file, task, number, docs, tokens, start: ids of all files before it) and the dictionary, which lies beside the
    files too.  Null keys come first; rows of one key stand in the order of their texts.  Null text is empty: the end id alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/tokens"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dictionary = train_dictionary(rows, path, "key", "text", end_id)
    store_dictionary(folder, dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, shard = TaskContext.get(), [], None

        def finish() -> None:
            shard.close()
            made.append((f"{folder}/{shard.path.rsplit('/', 1)[1]}", task.partitionId(), len(made), len(shard.entries), shard.tokens))

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), _documents(path, b.column(1), end_id), strict=True):
                if shard and shard.at >= shard_bytes:
                    finish()
                    shard = None
                shard = shard or ShardWriter(folder, f"tokens-{task.partitionId():06d}-{task.attemptNumber()}-{task.taskAttemptId()}-{len(made):04d}", dictionary, encoder(path).width)
                shard.add(k, ids)
        if shard:
            finish()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "task", "number", "docs", "tokens"), m, strict=True)) for m in made], pa.schema([("file", pa.string()), ("task", pa.int32()), ("number", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    # Many rows of one key, null or not, are ranged by how their texts begin: sampled bounds stay short.
    dealt = rows.withColumn("head", F.substring("text", 1, 64)).repartitionByRange("key", "head").sortWithinPartitions("key", "text").drop("head")
    manifest = materialize(dealt.mapInArrow(write, "file string, task int, number int, docs long, tokens long"), "manifest")
    # One row for a file: the running sum in one task is over files, not documents.
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), dictionary


def read_tokens(manifest: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone (and the dictionary beside them)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shard, start = Shard(r["file"], dictionary), r["start"]
                counts = shard.entries["ids"][:-1].astype(np.int64)
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(shard.docs)]
                keys = pa.array(shard.entries["key"][:-1], pa.int64(), mask=shard.entries["null"][:-1].astype(bool))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "start").repartition(max(1, min(READERS, manifest.count())), "file").mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest, _ = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest).withColumnRenamed("key", "doc_id")
