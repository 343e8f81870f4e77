"""Token counts by the whole-token shortcut: pre-tokens that are known to be one token are counted by look-up."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import pretokens
from .bpe import Merges
from .shared import small_batches
from .textops import byte_places, spread, texts_of

LIMIT = 512


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others
    from U+0100 on in their order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteLevelCounter:
    """Counts as a byte-level BPE file of the tokenizers library encodes."""

    def __init__(self, path: str) -> None:
        self.pre = pretokens.load(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[c] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs]) for k in (0, 1))
        self.merges = Merges(left, right, np.arange(len(pairs)), np.array([vocab[a + b] for a, b in pairs]))
        self.single, self.sure = self._proven(vocab, {c: b for b, c in enumerate(symbols)})

    def _proven(self, vocab: dict[str, int], byte: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes, sorted by the first, of the vocabulary's strings that the library itself encodes, alone, as one token."""
        strings = []
        for token in vocab:
            try:
                strings.append(bytes(byte[c] for c in token).decode())
            except (KeyError, UnicodeDecodeError):  # a special token, or part of a character: never a pre-token
                continue
        coded = self.pre.tokenizer.encode_batch(strings, add_special_tokens=False)
        alone = pa.array([s for s, e in zip(strings, coded, strict=True) if len(e.ids) == 1 and not any(x in s for x in self.pre.special)], pa.string())
        data, offsets = texts_of(alone)
        _, begin, end, _ = self.pre.cut(data, offsets)
        assert len(begin) == len(alone)
        pos = byte_places(data)
        found, sure = self.pre.hashes(data, pos[begin], pos[end])
        order = np.argsort(found)
        return found[order], sure[order]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text without special strings.  Pre-tokens are the same only if both their hashes are."""
        _, begin, end, text = self.pre.cut(data, offsets)
        pos = byte_places(data)
        begin, end = pos[begin], pos[end]
        found, sure = self.pre.hashes(data, begin, end)
        at = np.minimum(np.searchsorted(self.single, found), len(self.single) - 1)
        rest = np.flatnonzero((self.single[at] != found) | (self.sure[at] != sure))
        tokens = np.ones(len(begin), np.int64)
        if len(rest):
            _, first, which = np.unique(found[rest], return_index=True, return_inverse=True)
            other = sure[rest] != sure[rest[first]][which]
            if other.any():  # one first hash, two pre-tokens: each for itself
                which[other] = len(first) + np.arange(other.sum())
                first = np.concatenate([first, np.flatnonzero(other)])
            start, stop = begin[rest[first]], end[rest[first]]
            owner, rank = spread(stop - start)
            symbols = self.byte_id[data[start[owner] + rank]]
            ends = np.cumsum(stop - start)
            tokens[rest] = self.merges.encode(symbols, ends - (stop - start), ends)[1][which]
        return np.bincount(text, tokens, len(offsets) - 1).astype(np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = texts_of(column)
        raw, size = data.tobytes(), np.diff(offsets)
        special = np.zeros(len(size), bool)
        for s in self.pre.special:
            at = raw.find(s.encode())
            while at >= 0:
                special[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s.encode(), at + 1)
        tokens = self.count(data, offsets)
        for k in np.flatnonzero(special):  # the library takes these strings out before it cuts: it counts such texts
            tokens[k] = len(self.pre.tokenizer.encode(raw[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids)
        return size, tokens


class PieceCounter:
    """Counts as a sentencepiece model encodes.  Words there depend on no neighbour, but the library is as fast."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = texts_of(column)
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.diff(offsets), np.array([len(x) for x in self.model.encode(texts, num_threads=1)], np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> ByteLevelCounter | PieceCounter:
    return PieceCounter(path) if path.endswith(".model") else ByteLevelCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each document: the count that the library gives for the file at `path`,
    without begin, end or added special tokens, special strings within texts as the library's default has them.

    Which vocabulary strings encode alone as one token is proven once for each worker, by the library; a pre-token
    among them is counted by its hash.  Only the distinct others of a batch are merged.  No shuffle, nothing kept
    beyond a batch.  Null and empty texts have 0 bytes and tokens.  Repeated rows each get a row.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            size, tokens = c(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(count, f"{key} {dict(docs.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
