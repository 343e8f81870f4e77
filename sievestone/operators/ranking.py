"""TF-IDF in long form, cosine joins, leader clustering and research rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize, small_side
from . import retrieval


#: Sums of the same weights in another order differ by less.
SAFE = 1e-9


def vocabulary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, idf): idf = ln((N + 1) / (df + 1)) + 1.  N is one row, joined by broadcast."""
    n = docs.agg(F.count("*").alias("docs"))
    terms = docs.select(F.explode(F.array_distinct(T.ranking_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def vectors(docs: DataFrame, key: str, text: str, idf: DataFrame) -> DataFrame:
    """(key, term, w): L2-normalised tf-idf; terms outside the vocabulary weigh ln(100)."""
    counts = docs.select(F.col(key), F.explode(T.ranking_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c"))
    raw = counts.join(idf.select("term", "idf"), "term", "left").withColumn("x", F.col("c") * F.coalesce("idf", F.log(F.lit(100.0))))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("w"))


def cosine(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """(a_key, b_key, cosine) of all pairs that share a term: an equi-join on terms and a partial sum."""
    return a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), "term").groupBy(a_key, b_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def rank(docs: DataFrame, query: str, key: str, title: str, body: str, head: int | None = 5000, lead: int | None = 1000) -> DataFrame:
    """(key, cosine, jaccard, title_match, combined) of documents against one query, whose text is in the vocabulary.

    The cosine is with the first `head` characters of a body, jaccard with the first `lead`; None takes whole bodies.
    Vectors of documents are shuffled only where rows share a key, whose terms count together, or keys are no whole numbers."""
    spark = docs.sparkSession
    first = lambda c, n: F.col(c) if n is None else F.substring(c, 1, n)
    q = spark.createDataFrame([(query,)], "q string")
    rows = docs.select(F.col(key), F.coalesce(title, F.lit("")).alias("t"), F.coalesce(body, F.lit("")).alias("b"))
    idf = materialize(vocabulary(rows.select("b").unionByName(q.select(F.col("q").alias("b"))), "b", "b"))
    asked = materialize(vectors(q.withColumn("qk", F.lit(0)), "qk", "q", idf))
    full = rows.filter(F.col(key).isNotNull()).select(key, F.concat(F.repeat(F.concat("t", F.lit(" ")), F.lit(3)), first("b", head)).alias("x"))
    in_long_form = lambda some: cosine(vectors(some, key, "x", idf), key, asked, "qk").select(key, "cosine")
    if dict(rows.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
        weights = {r["term"]: r["w"] for r in asked.collect()}  # the terms of one query
        shared = small_side(materialize(full.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)))
        alone = retrieval.one_query(full.join(shared, key, "left_anti"), key, "x", idf, weights)
        cos = alone.unionByName(in_long_form(full.join(shared, key, "left_semi")))
    else:
        cos = in_long_form(full)
    near = rows.select(key, T.gram_similarity(first("b", lead), query).alias("jaccard"), T.gram_similarity(F.col("t"), query).alias("title_match"))
    near = materialize(near, T.TEXTS) if lead is None else near
    out = near.join(cos, key, "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    return out.withColumn("combined", F.least(F.col("cosine") * 0.5 + F.col("jaccard") * 0.2 + F.col("title_match") * 0.3, F.lit(1.0)))


def prefix_terms(v: DataFrame, idf: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, term): of each normalised vector (key, term, w) the rarest terms, as many as leave a rest shorter than the threshold.

    Two vectors whose product reaches the threshold share one of these terms: else all that they share lies in the rest of
    the one whose prefix ends first, and the product is at most that rest's length.  Frequent terms are in a prefix
    only where a text has little else."""
    rarest = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("term"))
    rest = F.sum(F.col("w") * F.col("w")).over(rarest.rowsBetween(Window.unboundedPreceding, 0))  # of this term and all more frequent ones
    return v.join(idf.select("term", "df"), "term").withColumn("rest", rest).filter(F.col("rest") >= threshold * threshold - SAFE).select(key, "term")


def similar_pairs(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(a, b, cosine) for pairs a < b at the threshold or above.  Only pairs that share a term of both prefixes are compared, each
    once, over all their terms; no pair is made of a term that is frequent in the prefixes of neither."""
    idf = materialize(vocabulary(docs, key, text))
    v = materialize(vectors(docs, key, text, idf))
    p = materialize(prefix_terms(v, idf, key, threshold))
    a, b = v.toDF("a", "term", "wa"), v.toDF("b", "term", "wb")
    met = p.toDF("a", "term").join(p.toDF("b", "term"), "term").filter("a < b").select("a", "b").distinct()
    return met.join(a, "a").join(b, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).filter(F.col("cosine") >= threshold)


def leader_clusters(keys: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, leader): one pass in key order, in which a row that no earlier leader took leads and takes later rows.

    Rounds settle rows whose smaller neighbours are settled: a leader is a row none of whose smaller neighbours leads."""
    pairs, open_ = materialize(pairs.select("a", "b")), materialize(keys.select(F.col(key).alias("b")).distinct())
    settled = None
    while open_.head(1):
        waiting = pairs.join(open_, "b", "left_semi")
        if settled is not None:
            waiting = waiting.join(settled.select(F.col("b").alias("a"), "leads"), "a", "left")
        else:
            waiting = waiting.withColumn("leads", F.lit(None).cast("boolean"))
        state = waiting.groupBy("b").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("hit"), F.bool_or(F.col("leads").isNull()).alias("wait"))
        judged = materialize(open_.join(state, "b", "left").withColumn("leads", F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("wait", F.lit(False)), True)))
        done = judged.filter("leads IS NOT NULL").select("b", "leads")
        settled = materialize(done if settled is None else settled.unionByName(done))
        open_ = judged.filter("leads IS NULL").select("b")
    if settled is None:
        return keys.select(F.col(key), F.col(key).alias("leader"))
    leaders = settled.filter("leads").select(F.col("b").alias("a"))
    first = pairs.join(leaders, "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
    return settled.join(first, "b", "left").select(F.col("b").alias(key), F.when(F.col("leads"), F.col("b")).otherwise(F.col("leader")).alias("leader"))


def blended(keyword: Column, semantic: Column) -> Column:
    return 0.4 * keyword + 0.6 * semantic


def research_rollup(results: DataFrame) -> DataFrame:
    """One row over scored results: counts and shares of sentiment, averages, tiers and signals."""
    n = F.greatest(F.count("*"), F.lit(1))
    bull, bear = F.count_if(F.col("sentiment") == "bullish"), F.count_if(F.col("sentiment") == "bearish")
    return results.agg(F.count("*").alias("articles"), bull.alias("bullish"), bear.alias("bearish"), F.count_if(F.col("sentiment") == "neutral").alias("neutral"), F.round(bull * 100 / n, 1).alias("bullish_pct"), F.round(bear * 100 / n, 1).alias("bearish_pct"),
                       F.when(bull > bear, "bullish").when(bear > bull, "bearish").otherwise("neutral").alias("overall"), F.round(F.avg("trust_score"), 3).alias("avg_trust"), F.round(F.avg("relevance_score"), 3).alias("avg_relevance"), F.count_if(F.col("trust_tier") == 1).alias("tier1"), F.count_if(F.col("trust_tier") == 2).alias("tier2"))


def top_per(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")
