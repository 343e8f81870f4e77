"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Merges
from .shared import small_batches
from .textops import U64, code_points, mix, spread, texts_of

DROPOUT, SEED = 0.1, 20_240_229
BAR = 0x2581  # stands for a space in pieces


class Codec:
    """A BPE model with byte fallback and spaces kept.  No piece has a space after another character, so the words
    (spaces, then other characters) of a text are encoded one by one; that is proven when the model is loaded."""

    def __init__(self, path: str) -> None:
        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        if any(chr(BAR) in p.lstrip(chr(BAR)) for p in normal) or n > 1 << 16 or sum(map(m.is_byte, range(n))) != 256:
            raise ValueError(f"{path}: not a byte-fallback BPE model whose pieces lie within words")
        self.byte_id = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        if any(self.char_id[ord(c)] < 0 for p in normal if len(p) > 1 for c in p):
            raise ValueError(f"{path}: a piece has a character that is no piece")
        pairs = [(normal[p[:k]], normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        left, right, into = (np.array(x) for x in zip(*pairs, strict=True))
        by_score = np.lexsort((np.arange(n), -np.array([m.get_score(i) for i in range(n)])))
        rank = np.empty(n, np.int32)
        rank[by_score] = np.arange(n)
        self.merges = Merges(left, right, rank[into], by_score)
        surface = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(chr(BAR), " ").encode() if p in normal else b"" for i, p in enumerate(pieces)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.cumsum([0, *map(len, surface)])

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray | None = None, dropout: float = 0.0, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has).  keys: a 64-bit number for each text; with it, the place of a word in
        its text and the seed, the hash that skips a merge is keyed."""
        cp, at = code_points(data, offsets)
        full = np.flatnonzero(at[1:] > at[:-1])  # an empty text has no pieces
        heads = at[:-1][full]
        # A space goes before every text, as the model has it.
        cp = np.insert(cp, heads, 32)
        starts = heads + np.arange(len(heads))
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        space = cp == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[starts] = True
        ids = np.where(space, self.char_id[BAR], self.char_id[cp])
        ids[cp == BAR] = -1  # a true U+2581 goes by its bytes, else it would come back as a space
        word_at = np.flatnonzero(begin)
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # characters without a piece become their bytes, which merge with nothing
            raw = np.frombuffer(cp[lost].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            size = np.ones(len(cp), np.int64)
            size[lost] = np.diff(np.append(lead, len(raw)))
            place = np.concatenate([[0], np.cumsum(size)])
            ids = np.repeat(ids, size)
            ids[ids < 0] = self.byte_id[raw]
            word_at, starts = place[word_at], place[starts]
        word_end = np.append(word_at[1:], len(ids))
        text = np.searchsorted(starts, word_at, "right") - 1
        word_keys = None
        if dropout:
            own = np.zeros(len(offsets) - 1, U64) if keys is None else keys.astype(U64)
            first = np.searchsorted(text, np.arange(len(full)))
            place = (np.arange(len(text)) - first[text]).astype(U64)
            word_keys = mix(own[full][text] ^ mix(np.array([seed], np.int64).astype(U64)) + place * U64(0x9E3779B97F4A7C15))
        out, counts = self.merges.encode(ids, word_at, word_end, word_keys, dropout)
        per = np.zeros(len(offsets) - 1, np.int64)
        per[full] = np.bincount(text, counts, len(full)).astype(np.int64)
        return out, per

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets): each text's pieces joined, without the space that encoding put first."""
        size = (self.surface_at[1:] - self.surface_at[:-1])[ids]
        owner, rank = spread(size)
        data = self.surface[self.surface_at[ids][owner] + rank]
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        full = counts > 0
        data = np.delete(data, at[:-1][full])
        return data, at - np.concatenate([[0], np.cumsum(full)])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(path: str, keys: pa.Array, texts: pa.Array, dropout: float, seed: int) -> tuple[Codec, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c = codec(path)
    data, offsets = texts_of(texts)
    own = np.array([zlib.crc32(str(k).encode()) for k in keys.to_pylist()], U64)
    return c, data, offsets, *c.encode(data, offsets, own, dropout, seed)


def _same(data: np.ndarray, offsets: np.ndarray, again: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each decoded text is the text."""
    same = np.diff(at) == np.diff(offsets)
    if len(again) == len(data):
        wrong = np.flatnonzero(again != data)
        same[np.searchsorted(offsets, wrong, "right") - 1] = False
    else:
        same &= [data[offsets[k] : offsets[k + 1]].tobytes() == again[at[k] : at[k + 1]].tobytes() for k in range(len(same))]
    return same


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text", out: str = "pieces") -> DataFrame:
    """docs with an array of piece ids of each whole text in column `out`.

    Without dropout these are the model's own ids (but for texts with a literal U+2581, which go by bytes so that
    decoding gives them back).  With it, each candidate merge that the agenda brings up is skipped if a hash of (seed,
    key, place of the word, step, merge) falls below `dropout`: the segmentation varies by seed and place, a run repeated
    gives the same, and every result decodes to the text.  Null and empty texts have no pieces.  Rows of the same key and
    text have the same pieces.  A column named `out` is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *_, ids, counts = _coded(path, b.column(names.index(key)), b.column(names.index(text)), dropout, seed)
            pieces = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, pieces], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, path: str, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """coded with the text of its pieces in column `out`; null or no pieces give ''."""
    small_batches(coded.sparkSession)
    coded = coded.drop(out)
    names = coded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            lists = b.column(names.index(pieces))
            counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            data, at = c.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())], [*names, out])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(out, T.StringType())]))


def digest(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_pieces, n_byte_pieces, ids_crc32, lossless) of each document's encoding with dropout: lossless
    says that decoding its ids gave the text's bytes back.  Rows as encode() has them; ids stay on the executors."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, data, offsets, ids, counts = _coded(path, b.column(0), b.column(1), dropout, seed)
            same = _same(data, offsets, *c.decode(ids, counts))
            ends = np.cumsum(counts)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[z - n : z].tobytes()) for z, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            fallback = np.concatenate([[0], np.cumsum(np.isin(ids, c.byte_id))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(fallback[ends] - fallback[ends - counts]), pa.array(crc, pa.int64()), pa.array(same)], [key, "n_bytes", "n_pieces", "n_byte_pieces", "ids_crc32", "lossless"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n_bytes long, n_pieces long, n_byte_pieces long, ids_crc32 long, lossless boolean")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the pieces of its text (a new segmentation by seed), and whether they decode to it.  Null and empty texts
    have no pieces and are lossless; rows of one id and text have the same pieces.  One Python step does both, so a task
    has one worker."""
    path, (key, text) = model_path(), ("doc_id", "text")
    docs = docs.drop("pieces", "lossless")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, data, offsets, ids, counts = _coded(path, b.column(names.index(key)), b.column(names.index(text)), DROPOUT, SEED)
            pieces = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, pieces, pa.array(_same(data, offsets, *c.decode(ids, counts)))], [*names, "pieces", "lossless"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())]))
