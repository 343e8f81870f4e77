"""Ranked retrieval: an inverted index of tf-idf weights in blocks of documents, searched with upper bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import discard, materialize, small_side

#: Documents of a block at most: bounds are kept for each term and block.
BLOCK = 4096
#: Tokens of a block at most, but for a block of one document; blocks that go to a task's Python at a time.
TOKENS, BATCH = 2_000_000, 1
#: Blocks that are searched first for each query, to learn what a result has to reach; queries that are searched together.
FIRST, TOGETHER = 2, 512
#: Weight of a term that no document has (a fixed value).
UNKNOWN = math.log(100)
#: Bounds and scores add the same numbers in different orders.
SAFE = 1e-9

_BLOCKS = "block long, ids binary, terms array<string>, dfs array<int>, at binary, c binary"
_INDEX = "term string, block long, idf double, most double, at binary, c binary, ids binary, norms binary"


@dataclass
class Index:
    """postings: one row for each term and block, with the term's idf, its largest weight in the block, and its documents there as
    places and counts; and for each block a row without a term, with its documents' keys and norms.  Rows are dealt by
    term and sorted by it, so a reader of few terms passes over most of a file.  vocabulary: (term, df, idf)."""

    rows: DataFrame
    vocabulary: DataFrame


def _inverted(docs: DataFrame) -> DataFrame:
    """Blocks of documents with their terms in order, and for each term the places and counts of the documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ends, low = np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while low < b.num_rows:
                before = ends[low - 1] if low else 0
                part = b.slice(low, min(BLOCK, max(1, int(np.searchsorted(ends, before + TOKENS, "right")) - low)))
                low += part.num_rows
                ids, tokens = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                coded = tokens.flatten().dictionary_encode()
                sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                pairs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs *= BLOCK
                pairs += np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
                pairs, counts = np.unique(pairs, return_counts=True)
                dfs = np.bincount(pairs // BLOCK, minlength=len(coded.dictionary))
                ends_of = pa.array([0, len(dfs)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids.astype("<i8").tobytes()]), pa.ListArray.from_arrays(ends_of, coded.dictionary), pa.ListArray.from_arrays(ends_of, pa.array(dfs.astype(np.int32))), pa.array([(pairs % BLOCK).astype("<u2").tobytes()]), pa.array([counts.astype("<u4").tobytes()])], ["block", "ids", "terms", "dfs", "at", "c"])
                number += 1

    return docs.mapInArrow(run, _BLOCKS)


def block_idfs(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(block, idf): the idfs of a block's terms in their order, UNKNOWN for those outside the vocabulary.  Only terms are shuffled."""
    terms = blocks.select("block", F.posexplode("terms").alias("place", "term")).join(vocabulary.select("term", "idf"), "term", "left")
    placed = terms.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("idf", F.lit(UNKNOWN)).alias("idf")))).alias("s"))
    return placed.select("block", F.col("s.idf").alias("idf"))


def _cut(raw: pa.Buffer, width: int, sizes: np.ndarray) -> pa.Array:
    """A block's numbers of that many bytes, term by term; nothing is copied."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * width, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), raw])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index rows of each block.  A block is not taken apart into Python objects, of which a term would need several."""
    names = [c.split()[0] for c in _INDEX.split(", ")]
    for block, raw_ids, terms, dfs, raw_at, raw_c, idfs in _each(batches):
        at, sizes, n = np.frombuffer(raw_at, "<u2"), dfs.to_numpy().astype(np.int64), len(raw_ids) // 8
        idf = np.zeros(0) if idfs is None else idfs.to_numpy()
        weight = np.frombuffer(raw_c, "<u4") * np.repeat(idf, sizes)
        norms = np.sqrt(np.bincount(at, weight * weight, n))
        weight /= norms[at]
        most = np.maximum.reduceat(weight, np.cumsum(sizes) - sizes) if len(terms) else idf
        none = pa.nulls(len(terms), pa.binary())
        yield pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(terms), block)), pa.array(idf), pa.array(most), _cut(raw_at, 2, sizes), _cut(raw_c, 4, sizes), none, none], names)
        last = [(None, pa.string()), (block, pa.int64()), (None, pa.float64()), (None, pa.float64()), (None, pa.binary()), (None, pa.binary()), (raw_ids.to_pybytes(), pa.binary()), (norms.astype("<f8").tobytes(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in last], names)


def build(docs: DataFrame, key: str, text: str) -> Index:
    """The index of all documents with a key, which is a whole number.

    Texts are read once, into blocks that hold each term once however many of its documents have it.  What is shuffled for
    the weights is a block's terms, not its documents': document frequencies by term, and the idfs back to the block,
    which has its documents' norms from them."""
    blocks = materialize(_inverted(docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), T.ranking_tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))), BLOCK)
    # Every row counts in the number of documents, also one without a key or a term.
    total = docs.count()
    counted = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    vocabulary = materialize(counted.select("term", "df", (F.log(F.lit(total + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    weights = materialize(block_idfs(blocks, vocabulary))
    both = blocks.join(weights, "block", "left")

    rows = both.select("block", "ids", "terms", "dfs", "at", "c", "idf").mapInArrow(_postings, _INDEX)
    index = materialize(rows.repartition(F.coalesce("term", F.col("block").cast("string"))).sortWithinPartitions("term", "block"), BATCH)
    discard(blocks)
    discard(weights)
    return Index(index, vocabulary)


def one_query(docs: DataFrame, key: str, text: str, vocabulary: DataFrame, asked: dict[str, float]) -> DataFrame:
    """(key, cosine) of every document that has a term with one query's normalised weights; keys are whole numbers.

    Texts become blocks in which a term stands once, so what is shuffled are the terms of blocks and no vectors of documents."""
    blocks = materialize(_inverted(docs.select(F.col(key).cast("long").alias("k"), T.ranking_tokens(F.col(text)).alias("w"))), BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = pa.array(list(asked), pa.string()), np.array([*asked.values(), 0.0])
        for raw_ids, terms, dfs, raw_at, raw_c, idf in _each(batches):
            if len(terms):
                at, sizes = np.frombuffer(raw_at, "<u2"), dfs.to_numpy()
                weight, ids = np.frombuffer(raw_c, "<u4") * np.repeat(idf.to_numpy(), sizes), np.frombuffer(raw_ids, "<i8")
                norms = np.sqrt(np.bincount(at, weight * weight, len(ids)))
                dots = np.bincount(at, weight * np.repeat(weights[pc.index_in(terms, words).fill_null(-1).to_numpy()], sizes), len(ids))
                has = norms > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(dots[has] / norms[has])], [key, "cosine"])

    found = materialize(blocks.join(block_idfs(blocks, vocabulary), "block").select("ids", "terms", "dfs", "at", "c", "idf").mapInArrow(run, f"{key} long, cosine double"), BATCH)
    discard(blocks)
    return found


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time: numbers as they are, binaries as buffers and lists as Arrow arrays, all in the batch's memory."""
    as_is = lambda x: x.as_buffer() if pa.types.is_binary(x.type) else x.values if pa.types.is_list(x.type) else x.as_py()
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(as_is(c[k]) for c in b.columns)


def _asked(index: Index, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(q, term, w): normalised tf-idf vectors of the queries, terms outside the vocabulary included in the norm only."""
    counts = materialize(queries.select(F.col(key).alias("q"), F.explode(T.ranking_tokens(F.col(text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("c")))
    known = index.vocabulary.join(small_side(counts.select("term").distinct()), "term", "left_semi").select("term", "idf")
    raw = counts.join(known, "term", "left").withColumn("x", F.col("c") * F.coalesce("idf", F.lit(UNKNOWN)))
    norm = raw.groupBy("q").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return materialize(raw.filter("idf IS NOT NULL").join(norm, "q").select("q", "term", (F.col("x") / F.col("norm")).alias("w")))


def _evaluated(index: Index, asked: DataFrame, pairs: DataFrame, k: int, digits: int, groups: int) -> DataFrame:
    """(q, id, score) of the k best documents of each pair (q, block), by the rounded score and then the least id."""
    share = F.pmod(F.xxhash64("q"), F.lit(groups)).alias("share")
    wanted = pairs.select("q", "block", share)
    use = wanted.select("block", "share").distinct()
    vectors = wanted.join(small_side(asked), "q").select("block", "share", "q", "term", "w")
    terms = asked.select("term", share).distinct()
    postings = index.rows.filter("term IS NOT NULL").join(small_side(terms), "term").join(small_side(use), ["block", "share"]).select("block", "share", "term", "idf", "at", "c", "ids", "norms")
    keys = index.rows.filter("term IS NULL").join(small_side(use), "block").select("block", "share", "term", "idf", "at", "c", "ids", "norms")

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        held, ids, norms = {}, np.zeros(0, np.int64), np.zeros(0)
        for term, idf, at, c, i, n in zip(*(rows[x].to_pylist() for x in ("term", "idf", "at", "c", "ids", "norms")), strict=True):
            if term is None:
                ids, norms = np.frombuffer(i, "<i8"), np.frombuffer(n, "<f8")
            else:
                held[term] = np.frombuffer(at, "<u2"), np.frombuffer(c, "<u4") * idf
        vectors: dict[object, list] = {}
        for q, term, w in zip(*(asked[x].to_pylist() for x in ("q", "term", "w")), strict=True):
            vectors.setdefault(q, []).append((term, w))
        out = []
        for q, vector in vectors.items():
            score, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
            for term, w in vector:
                if term in held:
                    at, x = held[term]
                    score[at] += w * x
                    seen[at] = True
            at = np.flatnonzero(seen)
            value = np.round(score[at] / norms[at], digits)
            best = np.lexsort((ids[at], -value))[:k]
            out += [(q, i, s) for i, s in zip(ids[at][best].tolist(), value[best].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], asked.schema.field("q").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["q", "id", "score"])

    return postings.unionByName(keys).groupBy("block", "share").cogroup(vectors.groupBy("block", "share")).applyInArrow(run, f"q {dict(pairs.dtypes)['q']}, id long, score double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= k).drop("_n")


def search(index: Index, queries: DataFrame, key: str, text: str, k: int, digits: int = 6) -> DataFrame:
    """(q, id, score): the k documents with the largest cosine with each query, equal ones by id.  Only documents with a term of
    the query count.  Scores are rounded to `digits`.

    A term's largest weight in a block bounds what it adds to any document there, so a query's bound for a block is a sum over its
    terms.  The blocks with the largest bounds are searched first; the k-th score found there is what others have to
    reach.  A block whose bound is below is not searched, nor one that has only terms whose bounds together are
    (they are the most frequent ones).  Postings of other blocks and terms stay where they are.
    """
    asked = _asked(index, queries, key, text)
    groups = max(1, math.ceil(asked.select("q").distinct().count() / TOGETHER))
    met = index.rows.select("term", "block", "most").filter("term IS NOT NULL").join(small_side(asked), "term").select("q", "block", "term", (F.col("w") * F.col("most")).alias("most"))
    met = materialize(met)
    bounds = materialize(met.groupBy("q", "block").agg(F.sum("most").alias("bound")))
    first = bounds.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))).filter(F.col("_n") <= FIRST).select("q", "block")
    first = materialize(first)
    early = materialize(_evaluated(index, asked, first, k, digits, groups))
    slack = 10.0**-digits + SAFE
    enough = _top(early, k).groupBy("q").agg(F.when(F.count("*") >= k, F.min("score") - slack).otherwise(-1.0).alias("floor"))
    enough = materialize(asked.select("q").distinct().join(enough, "q", "left").select("q", F.coalesce("floor", F.lit(-1.0)).alias("floor")))
    # Terms by their largest bound anywhere: the smallest ones, as long as they stay below the floor together, lead to nothing.
    largest = met.groupBy("q", "term").agg(F.max("most").alias("m"))
    rising = Window.partitionBy("q").orderBy("m", "term").rowsBetween(Window.unboundedPreceding, 0)
    leading = largest.withColumn("sum", F.sum("m").over(rising)).join(small_side(enough), "q").filter(F.col("sum") >= F.col("floor")).select("q", "term")
    worth = met.join(small_side(leading), ["q", "term"], "left_semi").select("q", "block").distinct()
    rest = bounds.join(worth, ["q", "block"], "left_semi").join(small_side(enough), "q").filter(F.col("bound") >= F.col("floor")).select("q", "block").join(first, ["q", "block"], "left_anti")
    late = _evaluated(index, asked, materialize(rest), k, digits, groups)
    return _top(early.unionByName(late), k)
