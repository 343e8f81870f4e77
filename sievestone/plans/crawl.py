"""The crawl and research dataflows over pages that a source has fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.html import PAGES, links
from ..functions.urls import followable, registered_domain, tier_label, trap_reason, trust, url_part
from ..operators import ranking
from ..operators.classify import extract
from ..operators.dedup import layered
from ..session import materialize

MIN_QUALITY, MIN_CONFIDENCE = 0.35, 0.4


def crawled(pages: DataFrame, as_of: Column, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The page log: one row for each page with its status, why, and the article where there is one.

    Cheap url rules stand before the parse; a trapped page is not parsed.  Duplicates are judged in key order, and
    only pages that pass the quality gate shadow later ones."""
    judged = pages.withColumn("trap", trap_reason(F.col(url)))
    trapped = judged.filter("trap IS NOT NULL").select(key, url, F.lit("skipped").alias("status"), F.col("trap").alias("reason"))
    rows = materialize(extract(judged.filter("trap IS NULL").drop("trap"), as_of, url, html), PAGES)  # a page is parsed once, its record read thrice
    gate = F.col("page_classification.is_content_page") | (F.col("page_classification.confidence") >= MIN_CONFIDENCE)
    content = rows.filter(gate)
    refused = rows.filter(~gate).select(key, url, F.lit("skipped").alias("status"), F.lit("not_content").alias("reason"))
    dup = layered(content, key, url, "canonical_url", "main_content", "title", F.col("quality_score") >= MIN_QUALITY)
    full = content.join(dup, key, "left").withColumn("is_duplicate", F.col("reason").isNotNull().cast("int"))
    low = (F.col("is_duplicate") == 0) & (F.col("quality_score") < MIN_QUALITY)
    full = full.withColumns({"status": F.when(low, "skipped").otherwise("fetched"), "reason": F.when(low, "low_quality").otherwise(F.col("reason"))})
    return full.unionByName(trapped, allowMissingColumns=True).unionByName(refused, allowMissingColumns=True)


def outlinks(pages: DataFrame, url: str = "url", html: str = "html", domains: list[str] | None = None) -> DataFrame:
    """(src, dst, ord): links of pages to pages of the same registered domain, or of the given ones.  A page is parsed once, however often this is read."""
    parsed = materialize(pages.select(F.col(url).alias("src"), links(F.col(url), F.coalesce(html, F.lit(""))).alias("dst")), PAGES)
    rows = parsed.select("src", F.posexplode("dst").alias("ord", "dst"))
    own, other = registered_domain(url_part(F.col("src"), "host")), registered_domain(url_part(F.col("dst"), "host"))
    near = own == other
    if domains:
        near = near | other.isin(domains)
    return rows.filter(followable(F.col("dst")) & near).select("src", "dst", "ord")


def research(articles: DataFrame, query: str, as_of: Column, min_trust: float = 0.30, key: str = "page_id") -> DataFrame:
    """The articles that scored() gives, best first."""
    return scored(articles, query, as_of, min_trust, key).orderBy(F.desc("combined_score"), key)


def scored(articles: DataFrame, query: str, as_of: Column, min_trust: float = 0.30, key: str = "page_id") -> DataFrame:
    """Scored articles for a query, in no order: gates, trust, relevance, quality and freshness, then the semantic blend.

    articles: url, title, main_content, published_date, word_count, quality_score and the key."""
    terms = T.query_terms(T.expand_query(query))
    t = trust(F.col("url"))
    rows = articles.filter((F.col("word_count") >= 150) & T.looks_like_article_title(F.col("title"))).withColumn("_t", t).filter(F.col("_t.score") >= min_trust).filter("quality_score >= 0.3")
    s = T.sentiment(F.col("main_content"), F.col("title"))
    rows = rows.withColumns({"trust_score": F.col("_t.score"), "trust_category": F.col("_t.category"), "trust_tier": F.col("_t.tier"), "trust_label": tier_label(F.col("_t.tier")), "keyword": T.relevance(F.col("main_content"), F.col("title"), terms), "key_signals": T.signals(F.col("main_content")), "_s": s, "freshness": T.decay(F.col("published_date"), as_of, 0.3)})
    floor = F.when(F.col("trust_tier") == 1, F.greatest("keyword", F.lit(0.20))).when(F.col("trust_tier") == 2, F.greatest("keyword", F.lit(0.10))).otherwise(F.col("keyword"))
    rows = rows.withColumn("keyword", floor).filter("keyword >= 0.05").withColumns({"sentiment": F.col("_s.label"), "sentiment_score": F.col("_s.score")}).drop("_s", "_t")
    passed = materialize(rows.select(key, "title", F.substring("main_content", 1, 2000).alias("_b")))  # the ranking reads it several times
    near = ranking.rank(passed, query, key, "title", "_b").select(key, F.col("combined").alias("semantic"))
    rows = rows.join(near, key).withColumn("relevance_score", ranking.blended(F.col("keyword"), F.col("semantic")))
    return rows.withColumn("combined_score", T.combined_score(F.col("trust_score"), F.col("relevance_score"), F.col("quality_score"), F.col("freshness")))


DEFAULTS = {"max_depth": 3, "max_links": 15, "min_trust": C.DEFAULT_TRUST[0]}
