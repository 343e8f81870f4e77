"""Line dedup: repeated lines' hashes go into minimal perfect hashes by shard, and documents probe their arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textops import U64, mix

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of a shard on average: its arrays are some 1.4 MB.
SHARD_LINES = 1 << 16
#: Pairs of line and document that go to one copy of a shard on average, and that a task holds before it deals them out.
PAIRS, HELD = 1 << 19, 1 << 20
#: Places for each line that is still without one, at every level of a perfect hash.
ROOM = 2
#: What stands for a null id: less than any other.
NO_ID = -(1 << 63)
_LEVELS = mix(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15))


# --- lines
def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() knows A-Z alone


def line_hash(line: bytes, min_chars: int) -> bytes:
    """16 bytes of BLAKE2b of a line's key, b"" for a key of fewer code points."""
    key = line_key(line)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return b""
    return hashlib.blake2b(key, digest_size=16).digest()


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _pairs(hashes: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as rows of two numbers, id of each) of a batch of documents' hashes."""
    parts = hashes.to_pylist()
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2), np.repeat(_ids(ids), [len(p) // 16 for p in parts])


# --- the index
class LineIndex:
    """A minimal perfect hash of distinct 128-bit line hashes with arrays by its value: fingerprint, count, last id.

    Level by level, hashes that are alone at their place in a bit array twice as large as they are many stay there; the
    others go on to the next level.  The value of a hash is the number of bits set before its own.  A hash that is not in the
    index also gets a value; its 64-bit fingerprint, which chose no place alone, tells it off."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        self.sizes, self.words, self.prints, self.counts, self.last = sizes, words, prints, counts, last
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes[:, 0] ^ mix(hashes[:, 1] + _LEVELS[level])) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        sizes, words, rest = [], [], hashes
        while len(rest):
            size = -(-ROOM * len(rest) // 64) * 64
            at = cls._place(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~alone]
        empty = cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, "<u8"), *words]), np.zeros(0, "<u8"), counts, last)
        order = np.empty(len(hashes), np.int64)
        order[empty.values(hashes)] = np.arange(len(hashes))
        return cls(empty.sizes, empty.words, hashes[order, 1], np.minimum(counts[order], 0xFFFFFFFF).astype("<u4"), last[order])

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 for one that has no place at any level."""
        out, rest, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self._place(hashes[rest], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            here = (word >> bit) & U64(1) == 1
            out[rest[here]] = self.before[at[here] >> 6] + np.bitwise_count(word[here] & ((U64(1) << bit[here]) - U64(1)))
            rest, base = rest[~here], base + size
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash that is in the index, -1 for others."""
        at = self.values(hashes)
        inside = np.flatnonzero(at >= 0)
        inside = inside[self.prints[at[inside]] == hashes[inside, 1]]
        out = np.full(len(hashes), -1, np.int64)
        out[inside] = at[inside]
        return out

    ARRAYS = ("sizes", "words", "prints", "counts", "last")

    def dump(self) -> list[bytes]:
        return [getattr(self, a).tobytes() for a in self.ARRAYS]

    @classmethod
    def load(cls, parts: list[bytes]) -> LineIndex:
        return cls(*(np.frombuffer(p, kind) for p, kind in zip(parts, ("<i8", "<u8", "<u8", "<u4", "<i8"), strict=True)))


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h) for each row: the distinct hashes, 16 bytes each, of its lines with a long enough key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [b"".join({line_hash(x, min_chars) for x in t.split(b"\n")}) for t in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["id", "h"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, h binary")


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n, last) of every line hash that at least min_docs rows hold.  A task adds up its batches' lines before they
    are shuffled, so a line that is in a third of all documents is a row for each batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, ids = _pairs(b.column(1), b.column(0))
            order = np.lexsort((h[:, 1], h[:, 0]))
            h, ids = h[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])) if len(h) else np.zeros(0, np.int64)
            last = np.maximum.reduceat(ids, first) if len(h) else ids
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first, 0].view(np.int64), h[first, 1].view(np.int64), np.diff(np.append(first, len(h))), last)], ["h1", "h2", "n", "last"])

    counted = lines.mapInArrow(run, "h1 long, h2 long, n long, last long").groupBy("h1", "h2")
    return counted.agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= min_docs)


def line_index(repeated: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: (shard, pairs, and the arrays of its LineIndex); pairs is how often its lines are held."""

    def build(table: pa.Table) -> pa.Table:
        shard, h1, h2, n, last = (c.to_numpy() for c in table.columns)
        index = LineIndex.build(np.stack([h1, h2], axis=1).view(U64), n, last)
        return pa.table([pa.array([x]) for x in (int(shard[0]), int(n.sum()), *index.dump())], ["shard", "pairs", *LineIndex.ARRAYS])

    rows = repeated.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2", "n", "last")
    return rows.groupBy("shard").applyInArrow(build, "shard long, pairs long, " + ", ".join(f"{a} binary" for a in LineIndex.ARRAYS))


def _dealt(lines: DataFrame, shards: int, copies: np.ndarray) -> DataFrame:
    """(shard, copy, h, ids): each task's hashes and their documents by shard, many in a row; copies of a shard in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, many = TaskContext.get().partitionId(), [], 0

        def out() -> pa.RecordBatch:
            h, ids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            shard = h[:, 0].view(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            which, first = np.unique(shard[order], return_index=True)
            parts = list(pairwise(np.append(first, len(h)).tolist()))
            return pa.RecordBatch.from_arrays([pa.array(which), pa.array(turn % copies[which]), pa.array([h[order[a:b]].tobytes() for a, b in parts], pa.binary()), pa.array([ids[order[a:b]].tobytes() for a, b in parts], pa.binary())], ["shard", "copy", "h", "ids"])

        for b in batches:
            held.append(_pairs(b.column(1), b.column(0)))
            many += len(held[-1][1])
            if many >= HELD:
                yield out()
                turn, held, many = turn + 1, [], 0
        if many:
            yield out()

    return lines.mapInArrow(run, "shard long, copy long, h binary, ids binary")


def dropped_lines(lines: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(id, hashes): for each document, the line hashes that it loses, being in the index with another document last.

    Hashes go to the shard that they belong to, not lines to lines: there the index row comes first, and what follows
    probes its arrays and is forgotten, so a task holds one shard and one row.  A shard that is asked for more often
    than others has its arrays in several copies, each asked by a part of the tasks."""
    total = lines.agg(F.coalesce(F.sum(F.octet_length("h")), F.lit(0))).first()[0] // 16
    copies = np.ones(shards, np.int64)
    for shard, pairs in index.select("shard", "pairs").collect():  # one number for each 65,536 repeated lines
        copies[shard] += (pairs + total // shards) // PAIRS
    schema = ", ".join(f"{a} binary" for a in LineIndex.ARRAYS)
    sizes = lines.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(copies)], "shard long, copies long")
    table = index.join(F.broadcast(sizes), "shard")
    table = table.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), *LineIndex.ARRAYS, F.lit(None).cast("binary").alias("h"), F.lit(None).cast("binary").alias("ids"))
    asked = _dealt(lines, shards, copies).select("shard", "copy", F.lit(1).alias("kind"), *[F.lit(None).cast("binary").alias(a) for a in LineIndex.ARRAYS], "h", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for b in batches:
            for k in range(b.num_rows):
                shard, copy, kind, *parts, h, ids = (c[k].as_py() for c in b.columns)
                if kind == 0:
                    index, of = LineIndex.load(parts), (shard, copy)
                    continue
                if of != (shard, copy):  # no repeated line is in this shard
                    continue
                h, ids = np.frombuffer(h, "<u8").reshape(-1, 2), np.frombuffer(ids, "<i8")
                at = index.find(h)
                lost = np.flatnonzero(at >= 0)
                lost = lost[index.last[at[lost]] != ids[lost]]
                lost = lost[np.argsort(ids[lost], kind="stable")]
                which, first = np.unique(ids[lost], return_index=True)
                cut = [h[lost[a:z]].tobytes() for a, z in pairwise(np.append(first, len(lost)).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(which, mask=which == NO_ID), pa.array(cut, pa.binary())], ["id", "h"])

    union = asked.unionByName(table).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    lost = union.select("shard", "copy", "kind", *LineIndex.ARRAYS, "h", "ids").mapInArrow(run, "id long, h binary")
    return lost.groupBy("id").agg(F.collect_list("h").alias("hashes"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: (key, text, n_lines, n_dropped), the text without its repeated lines.

    A line's key is the line without white space at its ends and with A-Z lower-cased.  Lines whose key has at least min_chars
    code points and is in at least min_docs rows go, except in the row or rows with the largest key column that hold it.
    Kept lines stay as they are.  Lines are told apart by 128 bits of BLAKE2b, of which the index compares all.

    Null and empty texts have one empty line and stay empty; a text that loses all lines is empty; a line that a text has
    twice counts once for it and goes or stays twice; repeated rows count each and lose the same lines; a null key is less
    than any other, and keys are whole numbers; long texts are one row; other columns are ignored; an empty table gives no rows.
    """
    lines = materialize(document_lines(docs, min_chars, key, text), "lines")
    repeated = materialize(repeated_lines(lines, min_docs), "repeated")
    shards = max(1, math.ceil(repeated.count() / SHARD_LINES))
    index = materialize(line_index(repeated, shards), "line_index")
    lost = materialize(dropped_lines(lines, index, shards), "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kept, gone = _texts(b.column(1)), [], []
            for t, cut in zip(texts, b.column(2).to_pylist(), strict=True):
                if cut:
                    out = {x[i : i + 16] for x in cut for i in range(0, len(x), 16)}
                    before = t.split(b"\n")
                    stay = [x for x in before if line_hash(x, min_chars) not in out]
                    gone.append(len(before) - len(stay))
                    t = b"\n".join(stay)
                else:
                    gone.append(0)
                kept.append(t)
            n = [t.count(b"\n") + 1 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [key, text, "n_lines", "n_dropped"])

    # Texts are shuffled once, beside the few hashes that they lose, and not sorted.
    both = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(lost.hint("shuffle_hash"), F.col("k").cast("long").eqNullSafe(F.col("id")), "left")
    return both.select("k", "t", "hashes").mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, `{text}` string, n_lines long, n_dropped long")


def query(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, line, place, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
