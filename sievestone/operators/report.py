"""The analytics report: each section is an aggregate over the page log or the articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..session import materialize, small_side

STATS = ["count", "mean", "median", "std", "min", "max", "p25", "p75", "p90", "iqr"]
CLEAN = "is_content = 1 AND is_duplicate = 0"


def describe(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Ten statistics of a column, by group or over all; zeros where there is no value.  Percentiles interpolate linearly,
    the standard deviation is the sample's, 0 for one value."""
    p = F.percentile(column, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9))))
    agg = df.groupBy(*([by] if by else [])).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), p.alias("p"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    at = lambda k: F.col("p")[k]
    made = {"mean": F.col("mean"), "median": at(1), "std": F.col("std"), "min": F.col("min").cast("double"), "max": F.col("max").cast("double"), "p25": at(0), "p75": at(2), "p90": at(3), "iqr": at(2) - at(0)}
    return agg.select(*([by] if by else []), "count", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(n) for n, c in made.items()])


def _rate(part: Column, whole: Column) -> Column:
    return F.round(part * 100.0 / F.greatest(whole, F.lit(1)), 1)


def crawl_health(pages: DataFrame) -> DataFrame:
    """One row: counts by status, rates and the grades of clean pages, in one pass."""
    n, clean = F.count("*"), F.expr(CLEAN)
    status = lambda s: F.count_if(F.col("status") == s)
    grades = [F.count_if(clean & (T.grade(F.col("quality_score")) == g)).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    return pages.agg(n.alias("total_urls"), F.count_if(clean).alias("clean_articles"), *[status(s).alias(s) for s in ("fetched", "blocked", "skipped", "error")], _rate(status("fetched"), n).alias("success_rate_pct"), _rate(status("blocked"), n).alias("block_rate_pct"),
                     _rate(F.count_if(F.expr("is_duplicate = 1")), n).alias("duplicate_rate_pct"), _rate(status("skipped"), n).alias("skip_rate_pct"), _rate(status("error"), n).alias("error_rate_pct"), *grades)


def efficiency(pages: DataFrame) -> DataFrame:
    """One row: yields, and shares of the waste by cause (errors are what is left)."""
    a = pages.agg(F.count("*").alias("total"), F.count_if(F.expr(CLEAN)).alias("clean"), F.count_if(F.expr("status = 'blocked'")).alias("blocked"), F.count_if(F.expr("status = 'skipped'")).alias("skipped"), F.count_if(F.expr("is_duplicate = 1")).alias("dup"),
                  F.coalesce(F.sum(F.when(F.expr(CLEAN), F.col("quality_score"))), F.lit(0.0)).alias("quality"))
    total, waste = F.greatest("total", F.lit(1)), F.col("total") - F.col("clean")
    share = lambda c: F.when(waste > 0, F.round(c * 100.0 / waste, 1))
    return a.select(F.col("total").alias("total_pages"), F.col("clean").alias("clean_articles"), _rate(F.col("clean"), F.col("total")).alias("yield_rate_pct"), _rate(waste, F.col("total")).alias("waste_rate_pct"), F.round(F.col("quality") / total, 4).alias("quality_weighted_yield"),
                    F.round(total / F.greatest("clean", F.lit(1)), 2).alias("pages_per_article"), F.round((1 - F.col("blocked") / total) * 100, 1).alias("block_avoidance_pct"), share(F.col("blocked")).alias("blocked_pct"), share(F.col("skipped")).alias("skipped_pct"), share(F.col("dup")).alias("duplicate_pct"),
                    share(waste - F.col("blocked") - F.col("skipped") - F.col("dup")).alias("error_pct"))


def pareto(df: DataFrame, by: str) -> DataFrame:
    """Groups by count, with shares and running shares.  The window is over the few groups, not over rows."""
    counts = df.groupBy(by).agg(F.count("*").alias("cnt"))
    every, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("cnt"), by)
    return counts.select(by, "cnt", F.round(F.col("cnt") * 100.0 / F.sum("cnt").over(every), 4).alias("pct"), F.round(F.sum("cnt").over(order) * 100.0 / F.sum("cnt").over(every), 4).alias("running_pct"), F.row_number().over(order).alias("rank"))


def top_counts(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), by).limit(n)


def top_terms(docs: DataFrame, text: str, n: int = 30, least_docs: int = 2) -> DataFrame:
    """Terms by corpus tf-idf: one explode of every occurrence and of every text's distinct words, summed by term beside the
    scan.  The counts are a table, so that texts are read once for them and their totals."""
    once = lambda w: F.concat(F.transform(w, lambda t: F.struct(t.alias("t"), F.lit(0).alias("d"), F.lit(1).alias("c"))), F.transform(F.array_distinct(w), lambda t: F.struct(t.alias("t"), F.lit(1).alias("d"), F.lit(0).alias("c"))))
    terms = docs.select(F.explode(T.bound(T.report_tokens(F.coalesce(text, F.lit(""))), once)).alias("x")).select("x.*")
    counted = materialize(terms.groupBy(F.col("t").alias("term")).agg(F.sum("d").alias("doc_frequency"), F.sum("c").alias("total_occurrences")))
    totals = counted.agg(F.greatest(F.coalesce(F.sum("total_occurrences"), F.lit(1)), F.lit(1)).alias("tf")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    scored = counted.filter(F.col("doc_frequency") >= least_docs).crossJoin(F.broadcast(totals))
    score = F.col("total_occurrences") / F.col("tf") * F.log((F.col("n") + 1) / (F.col("doc_frequency") + 1))
    return scored.select("term", F.round(score, 6).alias("tfidf_score"), "doc_frequency", F.round(F.col("doc_frequency") * 100 / F.col("n"), 1).alias("doc_pct"), "total_occurrences", score.alias("_s")).orderBy(F.desc("_s"), "term").limit(n).drop("_s")


def term_pairs(docs: DataFrame, key: str, text: str, terms: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the documents that hold each of few terms; whole texts count here."""
    few = small_side(materialize(terms.select("term")))
    words = docs.select(F.col(key).alias("d"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), 0))).alias("term")).join(few, "term")
    sets = materialize(words.groupBy("d").agg(F.sort_array(F.collect_list("term")).alias("t")))
    size = sets.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    pairs = sets.select(F.explode("t").alias("a"), "t").select("a", F.explode(F.filter("t", lambda x: x > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("both"))
    full = pairs.join(F.broadcast(size.toDF("a", "na")), "a").join(F.broadcast(size.toDF("b", "nb")), "b")
    return full.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def coverage(articles: DataFrame, kind: str, quality: str, words: str) -> DataFrame:
    """Every page type that is asked for, with zeros where there is none."""
    spark = articles.sparkSession
    wanted = spark.createDataFrame([(t,) for t in C.PAGE_TYPES], "page_type string")
    found = articles.groupBy(F.col(kind).alias("page_type")).agg(F.count("*").alias("cnt"), F.avg(quality).alias("q"), F.avg(words).alias("w"))
    return F.broadcast(wanted).join(found, "page_type", "left").select("page_type", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.round(F.coalesce("q", F.lit(0.0)), 3).alias("avg_quality"), F.round(F.coalesce("w", F.lit(0.0)), 0).alias("avg_words"), (F.coalesce("cnt", F.lit(0)) > 0).alias("covered"))


def feature_labels(author: Column, date: Column, words: Column, method: Column, html_quality: Column) -> Column:
    """The feature groups of an article; it is in several."""
    return F.array_compact(F.array(
        F.when(F.coalesce(author, F.lit("")) != "", "has_author").otherwise("no_author"), F.when(F.coalesce(date, F.lit("")) != "", "has_date").otherwise("no_date"),
        F.when(words < 300, "short_< 300w").when(words < 800, "medium_300-800w").when(words < 2000, "long_800-2000w").otherwise("very_long_> 2000w"),
        F.when(method.contains("trafilatura"), "trafilatura").when(method.contains("readability"), "readability").when(method.contains("bs4") | method.contains("heuristic"), "bs4_heuristic").when(method.isin("density", "parents"), method),
        F.when(html_quality.isin("clean", "noisy", "messy"), F.concat(F.lit("html_"), html_quality)),
    ))


def feature_quality(articles: DataFrame, labels: Column, quality: Column) -> DataFrame:
    rows = articles.select(F.explode(labels).alias("feature"), quality.cast("double").alias("q"))
    return rows.groupBy("feature").agg(F.count("*").alias("cnt"), F.round(F.avg("q"), 3).alias("avg_quality"), F.round(F.coalesce(F.stddev_samp("q"), F.lit(0.0)), 3).alias("std"))


def by_month(df: DataFrame, date: str, n: int = 12) -> DataFrame:
    """The last n months that have rows."""
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("cnt")).orderBy(F.desc("month")).limit(n)


def by_day(df: DataFrame, date: str, n: int = 30) -> DataFrame:
    return df.groupBy(F.date_format(date, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("cnt")).orderBy(F.desc("day")).limit(n)


def mode_of(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("cnt"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("cnt"), F.col(value))).alias(value), F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "cnt")))).alias("mix"))


def domain_profiles(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """Counts, rates, quality, usual type and language, and score of each domain of the page log; domains without articles stay."""
    log = pages.groupBy("domain").agg(F.count("*").alias("pages"), F.count_if(F.expr("status = 'blocked'")).alias("blocked"))
    good = articles.groupBy("domain").agg(F.count("*").alias("articles"), F.avg(F.when(F.col("quality_score") != 0, F.col("quality_score"))).alias("quality"), F.avg("word_count").alias("words"), F.mode("page_type", deterministic=True).alias("page_type"), F.mode("language", deterministic=True).alias("language"))
    full = log.join(good, "domain", "left").na.fill(0, ["articles", "quality", "words"])
    block = F.col("blocked") / F.greatest("pages", F.lit(1))
    return full.select("domain", "pages", "articles", F.round(block * 100, 1).alias("block_rate_pct"), _rate(F.col("articles"), F.col("pages")).alias("yield_pct"), F.round("quality", 4).alias("avg_quality"), F.round("words", 1).alias("avg_words"), "page_type", "language", F.round(T.domain_score(F.col("pages"), F.col("articles"), F.col("quality"), block), 4).alias("domain_score"))


def completeness(articles: DataFrame, fields: list[str]) -> DataFrame:
    """(field, cnt, pct) of rows in which a field is neither null nor empty; one pass, then unpivoted."""
    kinds = dict(articles.dtypes)
    has = lambda c: F.size(c) > 0 if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    row = articles.agg(F.count("*").alias("_n"), *[F.count_if(has(c)).alias(c) for c in fields])
    return row.unpivot(["_n"], fields, "field", "cnt").select("field", "cnt", _rate(F.col("cnt"), F.col("_n")).alias("pct"))


def full_report(pages: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """All sections by name.  Inputs are cached by the caller if they are not tables."""
    dup = pages.filter("is_duplicate = 1")
    return {
        "crawl_health": crawl_health(pages), "efficiency": efficiency(pages), "quality": describe(articles, "quality_score"), "words": describe(articles, "word_count"), "languages": top_counts(articles, "language", 20),
        "problems": top_counts(articles.select(F.explode("problems_detected").alias("problem")), "problem", 15), "keywords": top_terms(articles, "main_content"), "months": by_month(articles.withColumn("d", T.published(F.col("published_date"))).filter("d IS NOT NULL"), "d"),
        "duplicates": top_counts(dup.select(T.duplicate_method(F.col("reason")).alias("method")), "method", 10), "domains": domain_profiles(pages, articles), "coverage": coverage(articles, "page_type", "quality_score", "word_count"),
        "features": feature_quality(articles, feature_labels(*[F.col(c) for c in ("author", "published_date", "word_count", "extraction_method", "html_quality")]), F.col("quality_score")),
    }
