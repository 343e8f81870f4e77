"""Benchmark decontamination: item-sized windows of documents, embedded so that edit distance becomes Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import LOWER, U64, WORD, mix, runs, spread, texts_of, word_hashes

SIMILARITY = 0.8
#: Items of fewer words can't be told from ordinary text: leaks() reports where they stand, clean() removes nothing for them.
MIN_WORDS = 5
#: Items of fewer words have too few windows to sample: they are looked for by unchanged pieces, exactly.
SHORT_WORDS = 12
#: Hash tables, each of its own embedding; steps of the walk that may be sampled, and how many of them are.
REPEATS, STEPS, SAMPLED = 6, 13, 6
#: Words of items in one index, which every task holds (about 100 bytes each); more are looked for in several passes.
ITEM_WORDS = 200_000
#: Cells of the edit tables that are filled at a time.
CELLS = 1 << 20
#: Rows of the edit tables after which hopeless pairs are left out.
CULL = 3
_SEED = U64(0x9E3779B97F4A7C15)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, offsets of each text among them): words of digits, letters and what is beyond ASCII,
    A-Z lower-cased, so punctuation and line ends make no difference."""
    data, offsets = texts_of(column)
    low = LOWER[data]
    begin, end, doc = runs(WORD[low], offsets)
    return word_hashes(low, begin, end)[0] | U64(1), np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))]).astype(np.int64)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i : i + size] for every i."""
    out = np.zeros(max(0, len(words) - size + 1), U64)
    for j in range(size):
        out = mix(out * U64(3) + words[j : j + len(out)])
    return out


def walked(words: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the sampled symbols, how many words on the walk's last sample stands) of embedding `repeat` of the windows that
    begin at every word.

    The CGK walk writes the symbol it stands at and moves on if a random bit of (embedding, step, symbol) says so: edits
    become few differing places, since after an edit two walks soon stand at the same symbols again.  Of its places SAMPLED
    among the first STEPS are read; a window begins at every word, so later places are read by later windows."""
    n = len(words)
    bits = np.zeros(n + STEPS, np.uint16)
    bits[:n] = mix(words ^ mix(np.array([repeat + 1], U64) * _SEED)) >> U64(64 - STEPS)
    symbols = np.concatenate([words, np.zeros(STEPS, U64)])
    picks = np.sort(np.argsort(mix(np.arange(STEPS, dtype=U64) + U64(1000 * (repeat + 1))))[:SAMPLED]).tolist()
    start = np.arange(n)
    at, out = start.copy(), np.full(n, U64(repeat + 1), U64)
    for j in range(picks[-1] + 1):
        if j in picks:
            out *= U64(0xD6E8FEB86659FD93)
            out += symbols[at]
        if j < picks[-1]:
            at += ((bits >> j) & 1).astype(np.int8)[at]
    return mix(out), at - start


class Table:
    """Hashes with the item and the word in it that each belongs to, by hash; a bitmap tells most others off."""

    def __init__(self, hashes: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.offset = hashes[order], item[order], offset[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> U64(42)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of hashes, item, offset) of all that are equal."""
        at = np.flatnonzero(self.seen[(hashes >> U64(42)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        owner, rank = spread(high - low)
        which = low[owner] + rank
        return at[owner], self.item[which], self.offset[which]


class Index:
    """Items' words, hash tables of the sampled embeddings of their windows, and the pieces of short items: within k edits of an
    item, one of k + 1 pieces of it is unchanged."""

    def __init__(self, ids: list, words: np.ndarray, at: np.ndarray, similarity: float) -> None:
        self.ids, self.words, self.at = ids, words, at
        self.size = np.diff(at)
        self.edits = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        item, offset = spread(self.size)
        self.tables = []
        for r in range(REPEATS):
            hashes, seen = walked(words, r) if len(words) else (words, offset)
            own = (self.size[item] >= SHORT_WORDS) & (offset + seen < self.size[item])
            self.tables.append(Table(hashes[own], item[own], offset[own]))
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero((self.size > 0) & (self.size < SHORT_WORDS)).tolist():
            m, k = int(self.size[i]), int(self.edits[i])
            for p in range(k + 1):
                a, b = p * m // (k + 1), (p + 1) * m // (k + 1)
                rows.setdefault(b - a, []).append((int(_grams(words[at[i] + a : at[i] + b], b - a)[0]), i, a))
        self.pieces = {size: Table(np.array([x[0] for x in r], U64), np.array([x[1] for x in r]), np.array([x[2] for x in r])) for size, r in rows.items()}

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, about where the item would start) of what hash tables and pieces propose.  Starts are rounded down to
        multiples of the item's edits and one: proposals of one place are one."""
        found = []
        if len(words):
            for r, table in enumerate(self.tables):
                hashes, seen = walked(words, r)
                found.append((seen, *table.find(hashes)))
            for size, table in self.pieces.items():
                found.append((np.full(len(words), size - 1), *table.find(_grams(words, size))))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        doc, item, start = [], [], []
        for seen, place, i, offset in found:
            d = np.searchsorted(offsets, place, "right") - 1
            inside = place + seen[place] < offsets[d + 1]
            doc.append(d[inside])
            item.append(i[inside])
            start.append((place - offset)[inside])
        doc, item, start = np.concatenate(doc), np.concatenate(item), np.concatenate(start)
        start = (start - offsets[doc]) // (self.edits[item] + 1) * (self.edits[item] + 1) + offsets[doc]
        key = np.unique(np.stack([doc, item, start]), axis=1)
        return key[0], key[1], key[2]

    def matches(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, least edit distance) of the pairs within the item's edits, by exact comparison."""
        doc, item, start = self.candidates(words, offsets)
        if not len(doc):
            return doc, item, start
        k = self.edits[item]
        # An item's start is off by its edits at most, before or behind what an agreeing place says, and by the rounding.
        low = np.maximum(offsets[doc], start - k)
        high = np.minimum(offsets[doc + 1], start + self.size[item] + 3 * k + 1)
        distance, x = np.zeros(len(doc), np.int64), 0
        order = np.argsort(self.size[item], kind="stable")  # like sizes together
        while x < len(order):
            y = min(len(order), x + 4096)
            y = x + max(1, min(y - x, CELLS // int((high - low)[order[x:y]].max() + 1)))
            e = order[x:y]
            distance[e] = substring_distance(self.words, self.at[item[e]], self.size[item[e]], words, low[e], high[e], k[e])
            x = y
        near = distance <= k
        doc, item, distance = doc[near], item[near], distance[near]
        order = np.lexsort((distance, item, doc))
        doc, item, distance = doc[order], item[order], distance[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[new], item[new], distance[new]


def substring_distance(items: np.ndarray, at: np.ndarray, size: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Least edit distance between each item and any substring of words[low:high]; beyond `limit`, some number above it.

    The least entry of a row of the table never falls from row to row: pairs above their limit are left out of the rest."""
    width = int((high - low).max())
    kind = np.int16 if width + int(size.max()) < 1 << 14 else np.int32
    column = np.arange(width + 1, dtype=kind)
    inside = column[:-1] < (high - low)[:, None]
    text = np.where(inside, words[np.minimum(low[:, None] + np.arange(width), len(words) - 1)], U64(0))
    # Numbers in place of words: a word's place among all of these texts' and items' words.
    known, text = np.unique(text, return_inverse=True)
    text = text.reshape(len(at), width).astype(np.int32)
    own = items[np.minimum(at[:, None] + np.arange(int(size.max())), len(items) - 1)]
    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
    own = np.where(known[place] == own, place, -1).astype(np.int32)
    row, live = np.zeros((len(at), width + 1), kind), np.arange(len(at))
    out = limit + 1
    best = np.empty_like(row)
    for i in range(own.shape[1]):
        np.add(row, 1, out=best)
        np.minimum(best[:, 1:], row[:, :-1] + (text != own[:, i, None]), out=best[:, 1:])
        best -= column
        np.minimum.accumulate(best, 1, out=row)
        row += column
        if i % CULL == CULL - 1 or (size[live] == i + 1).any():
            least = row.min(1)
            done = size[live] == i + 1
            out[live[done]] = least[done]
            go_on = ~done & (least <= limit[live])
            if not go_on.any():
                break
            if go_on.mean() < 0.8:
                live, row, text, own = live[go_on], row[go_on], text[go_on], own[go_on]
                best = np.empty_like(row)
    return out


def _indexes(items: DataFrame, similarity: float, key: str, text: str, least: int) -> Iterator[Index]:
    """The items of at least `least` words, in blocks of ITEM_WORDS words: one is on the driver at a time."""
    block, held = [], 0

    def close() -> Index | None:
        words, at = words_of(pa.array([r[1] for r in block], pa.string()))
        long = np.flatnonzero(np.diff(at) >= least)
        if not len(long):
            return None
        owner, rank = spread(np.diff(at)[long])
        return Index([block[k][0] for k in long], words[at[:-1][long][owner] + rank], np.concatenate([[0], np.cumsum(np.diff(at)[long])]), similarity)

    for r in items.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        block.append(r)
        held += len(r[1]) // 4 + 1
        if held >= ITEM_WORDS:
            if x := close():
                yield x
            block, held = [], 0
    if block and (x := close()):
        yield x


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, distance, item_words) for every document and item of which a passage of the document is within
    (1 - similarity) * item_words word edits; distance is the least that was found.

    Items are sent to every task in blocks of ITEM_WORDS words, each with a pass over the documents, which are never
    shuffled.  Windows begin at every word of a document and of an item, so whatever part of an item is unchanged can
    be what a table agrees in; a pair within the edits is found with high probability (0.99 and more is measured in the tests),
    an unchanged item always, and items under SHORT_WORDS words by exact look-up.  What is found is exact.  Null or empty texts
    match nothing, repeated rows give repeated pairs, empty tables give empty ones, other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"{key} {kinds[0]}, {item_key} {kinds[1]}, distance long, item_words long"
    out = None
    for index in _indexes(items, similarity, item_key, item_text, 1):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            x = held.value
            ids = pa.array(x.ids)
            for b in batches:
                doc, item, distance = x.matches(*words_of(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), ids.take(pa.array(item)), pa.array(distance), pa.array(x.size[item])], [key, item_key, "distance", "item_words"])

        part = docs.select(key, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which leaks() finds no item of MIN_WORDS words or more, as they are: null and empty texts, repeated
    rows and rows without a key stay.  Nothing is shuffled or joined."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)
    for index in _indexes(items, similarity, item_key, item_text, MIN_WORDS):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[held.value.matches(*words_of(b.column(place)))[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (items of MIN_WORDS words or more); rows go and stay by their own text."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
