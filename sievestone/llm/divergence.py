"""Source divergence audit: what the sources of a language say more or less often than each other and the language."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .ordering import positions
from .shared import bounded_broadcast, materialize

#: Terms: letters a-z, lower-cased from A-Z, and all beyond ASCII.  On UTF-8 bytes this is the same as on characters.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
MIN_DOCS, TOP = 10, 10
#: Kept terms in a chunk of the dictionary, and sources in a block: a pair of blocks has 64 vectors of a chunk, 0.5 MB.
CHUNK, BLOCK = 1024, 32
SCALE, DIGITS = 1000, 3
#: Different words a task adds up before it lets them go.
HELD = 1 << 17


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of every term in every group.  A task adds up its documents
    first, so a group or term with a third of all rows is one row for each task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def out() -> pa.RecordBatch:
            sizes = [len(count) for count, _ in held.values()]
            group = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            names = [pa.array([k[i] for k in held], pa.string()).take(pa.array(group)) for i in (0, 1)]
            terms = pa.array((t for count, _ in held.values() for t in count), pa.binary())
            n = np.fromiter((x for count, _ in held.values() for x in count.values()), np.int64, len(group))
            df = np.fromiter((d[t] for count, d in held.values() for t in count), np.int64, len(group))
            return pa.RecordBatch.from_arrays([*names, terms, pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

        for b in batches:
            for k, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                terms = TERM.findall(t.lower())
                count, df = held[k, s]
                count.update(terms)
                df.update(set(terms))
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield out()
                held.clear()
        yield out()

    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = clean.mapInArrow(run, "lang string, source string, term binary, n long, df long")
    return counted.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def dictionary_of(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, chunk, terms, totals): the kept terms of every language in UTF-8 order, CHUNK of them in a row, and how often the
    language has each.  A term's id is its place in that order."""
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).filter(F.col("df") >= min_docs).select("lang", "term", "n")
    placed = positions(materialize(kept, "kept"), ["lang", "term"], "ranked")
    first = placed.groupBy("lang").agg(F.min("pos").alias("first")).withColumnRenamed("lang", "l")
    ids = placed.join(bounded_broadcast(first), F.col("l") == F.col("lang")).select("lang", "term", "n", (F.col("pos") - F.col("first")).alias("id"))
    rows = ids.groupBy("lang", F.expr(f"id div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("id", "term", "n"))).alias("s"))
    return rows.select("lang", "chunk", F.expr("transform(s, x -> x.term)").alias("terms"), F.expr("transform(s, x -> x.n)").alias("totals"))


def chunk_of(firsts: dict[str, list[bytes]]) -> Callable[..., Column]:
    """A function from (lang, term) columns to chunks, by the first term of each."""

    @F.pandas_udf("long")
    def chunk(lang: pd.Series, term: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(firsts[k], t.encode()) - 1 for k, t in zip(lang, term, strict=True)], dtype="int64")

    return chunk


def vectors(kept: DataFrame, dictionary: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, chunk, g, n): for every group (lang, source, g) with a kept term in a chunk the dense counts of its terms, as bytes.

    Terms go to their chunk by the chunks' first terms, one string for each 1,024 kept terms; a chunk's sorted terms
    turn them into ids, and ids into places of the vector."""
    firsts: defaultdict[str, list[bytes]] = defaultdict(list)
    for lang, _, term in sorted(map(tuple, dictionary.select("lang", "chunk", F.col("terms")[0]).collect())):
        firsts[lang].append(term.encode())
    rows = kept.join(bounded_broadcast(groups.select("lang", "source", "g")), ["lang", "source"])
    rows = rows.select("lang", chunk_of(dict(firsts))("lang", "term").alias("chunk"), F.expr(f"g div {BLOCK}").alias("block"), "g", "term", "n")
    blocks = groups.select("lang", F.expr(f"g div {BLOCK}").alias("block")).distinct()
    frames = dictionary.select("lang", "chunk", "terms").join(bounded_broadcast(blocks), "lang")

    def encode(rows: pa.Table, frame: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if rows.num_rows:
            sorted_terms = np.array([t.encode() for t in frame["terms"][0].as_py()], object)
            ids = np.searchsorted(sorted_terms, np.array([t.encode() for t in rows["term"].to_pylist()], object))
            g, width = rows["g"].to_numpy(), len(sorted_terms)
            which, row = np.unique(g, return_inverse=True)
            # Weights of bincount are doubles, exact for counts below 2**53.
            dense = np.bincount(row * width + ids, rows["n"].to_numpy(), len(which) * width).astype("<i8").reshape(-1, width)
            out = (which.tolist(), [v.tobytes() for v in dense])
        n = len(out[0])
        return pa.table([pa.array([x] * n, t) for x, t in ((n and rows["lang"][0].as_py(), pa.string()), (n and rows["chunk"][0].as_py(), pa.int64()))] + [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["lang", "chunk", "g", "n"])

    keys = ["lang", "chunk", "block"]
    return rows.groupBy(*keys).cogroup(frames.groupBy(*keys)).applyInArrow(encode, "lang string, chunk long, g long, n binary")


@F.pandas_udf(BinaryType())
def _packed(counts: pd.Series) -> pd.Series:
    return counts.map(lambda v: np.asarray(v, "<i8").tobytes())


def smoothed(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exact in 64 bits: long division by three digits at a time."""
    rest, by, out = counts + 2, total + 2 * kept, np.zeros(len(counts), np.int64)
    for _ in range(DIGITS):
        rest = rest * SCALE
        out = out * SCALE + rest // by
        rest = rest % by
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(top: int) -> Callable[[pa.Table], pa.Table]:
    """What a chunk gives for two blocks of groups: the pairs' sums there, and within a block each group's nearest `top` terms."""

    def run(table: pa.Table) -> pa.Table:
        lang, chunk, a, b = (table[c][0].as_py() for c in ("lang", "chunk", "a", "b"))
        width, kept = table["width"][0].as_py(), table["kept"][0].as_py()
        zero = np.zeros(width, np.int64)
        rows = {g: (np.frombuffer(v, "<i8") if v is not None else zero, total) for g, v, total in zip(*(table[c].to_pylist() for c in ("g", "n", "total")), strict=True)}
        p = {g: smoothed(v, total, kept) for g, (v, total) in rows.items()}
        out = []
        for g in (g for g in rows if g >= 0 and g // BLOCK == a):
            out += [(g, h, None, int(distance(p[g], p[h]).sum())) for h in rows if h // BLOCK == b and h > g]
            if a == b and width:
                f = np.where((rows[g][0] > 0) & (p[g] > p[-1]), distance(p[g], p[-1]), -1)
                best = np.argsort(-f, kind="stable")[:top]  # ids break ties: they are in the terms' order
                out += [(g, None, int(chunk * CHUNK + i), int(f[i])) for i in best if f[i] >= 0]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array([lang] * len(out), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["lang", "g", "h", "id", "value"])

    return run


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for every group (lang, source), its divergence from each other source of the
    language (part `pair`, all of them) and the terms that it has most beyond the language (part `term`, the first `top`).

    A language keeps the terms that min_docs of its rows have.  With count occurrences of a kept term in a group, N of all kept ones and V
    kept terms, p = 1 + floor(10**9 (count + 2) / (N + 2 V)) and f = floor((p - q)**2 / (p + q)), in whole numbers.  A pair's value is
    f summed over the kept terms, a term's is f against the language where p > q.  Ranks go by value, then item by its bytes.

    Terms are integers in UTF-8 order, chunks of them dense vectors.  A group without a term in a chunk is a vector of zeros there.
    Groups are compared block by block and chunk by chunk, and only sums and first terms leave a comparison.

    Null text, lang and source are empty strings; a group without terms has its pairs; a language without kept terms has pairs of
    value 0; ties of terms go by id; repeated rows count each; a long text is one row; other columns are ignored; an empty table
    gives no rows.
    """
    counts = materialize(term_counts(docs, lang, source, text), "counts")
    dictionary = materialize(dictionary_of(counts, min_docs), "dictionary")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    placed = positions(materialize(named, "groups"), ["lang", "source"], "sources")
    first = placed.groupBy("lang").agg(F.min("pos").alias("first"), F.count("*").alias("sources")).withColumnRenamed("lang", "l")
    groups = materialize(placed.join(bounded_broadcast(first), F.col("l") == F.col("lang")).select("lang", "source", (F.col("pos") - F.col("first")).alias("g"), "sources"), "numbered")
    terms = dictionary.select("lang", F.explode("terms").alias("term"))
    kept = materialize(counts.join(terms, ["lang", "term"], "left_semi"), "kept_counts")
    dense = materialize(vectors(kept, dictionary, groups), "vectors")
    sums = "aggregate({0}, 0L, (a, x) -> a + x)"
    langs = dictionary.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"), F.sum(F.expr(sums.format("totals"))).alias("all"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(bounded_broadcast(langs), "lang", "left").join(bounded_broadcast(totals), ["lang", "source"], "left").na.fill(0, ["kept", "all", "total"])
    groups = materialize(groups, "sized")
    # Every group has every chunk of its language; one without kept terms has one chunk of no width.
    spread = groups.select("lang", "g", "total", "kept", "sources", F.explode(F.expr(f"sequence(0L, greatest((kept - 1) div {CHUNK}, 0L))")).alias("chunk"))
    own = spread.join(dense, ["lang", "chunk", "g"], "left").withColumn("mine", F.expr(f"g div {BLOCK}"))
    partners = f"sequence(0L, (sources - 1) div {BLOCK})"
    paired = own.select("lang", "chunk", "g", "n", "total", "kept", F.expr(f"explode(transform({partners}, x -> struct(least(x, mine) AS a, greatest(x, mine) AS b)))").alias("ab")).select("*", "ab.*").drop("ab")
    # The language itself stands in every block as group -1, for the terms.
    whole = groups.select("lang", "kept", "all", F.expr(f"g div {BLOCK}").alias("a")).distinct()
    itself = dictionary.select("lang", "chunk", _packed("totals").alias("n")).join(bounded_broadcast(whole), "lang").select("lang", "chunk", F.lit(-1).cast("long").alias("g"), "n", F.col("all").alias("total"), "kept", "a", F.col("a").alias("b"))
    rows = paired.unionByName(itself).withColumn("width", F.expr(f"greatest(least(kept - chunk * {CHUNK}, {CHUNK}L), 0L)"))
    found = materialize(rows.groupBy("lang", "chunk", "a", "b").applyInArrow(_compared(top), "lang string, g long, h long, id long, value long"), "compared")
    names = groups.select("lang", "g", "source")
    sides = found.filter("h IS NOT NULL").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    sides = sides.unionByName(sides.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    pairs = sides.join(bounded_broadcast(names.withColumnRenamed("g", "h").withColumnRenamed("source", "item")), ["lang", "h"]).select("lang", "g", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("value"), "item")))
    best = found.filter("id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("value"), "id"))).filter(F.col("rank") <= top)
    words = dictionary.select("lang", "chunk", "terms").withColumnRenamed("lang", "l")
    best = best.join(words, (F.col("l") == F.col("lang")) & (F.expr(f"id div {CHUNK}") == F.col("chunk"))).select("lang", "g", F.lit("term").alias("part"), F.expr(f"terms[cast(id % {CHUNK} AS int)]").alias("item"), "value", "rank")
    return pairs.unionByName(best).join(bounded_broadcast(names), ["lang", "g"]).select("lang", "source", "part", "item", "value", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d), kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang), grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v) AS q FROM grp g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
