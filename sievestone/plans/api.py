"""What a dashboard asks for, as functions of the page log and the articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import report

ARTICLE_FIELDS = ["title", "author", "published_date", "main_content", "headings", "canonical_url", "images", "source_domain", "language", "summary"]


def stats(pages: DataFrame, queue: DataFrame | None = None) -> dict[str, DataFrame]:
    out = {"totals": report.crawl_health(pages)}
    return out | ({"queue": queue.groupBy("status").agg(F.count("*").alias("cnt"))} if queue is not None else {})


def articles(pages: DataFrame, n: int = 50) -> DataFrame:
    """The latest clean articles."""
    return pages.filter(report.CLEAN).orderBy(F.desc("crawled_at"), "url").limit(n)


def domains(pages: DataFrame, n: int = 50) -> DataFrame:
    return pages.groupBy("domain").agg(F.count("*").alias("pages_crawled"), F.count_if(F.col("status") == "blocked").alias("pages_blocked"), F.count_if(F.col("status") == "skipped").alias("pages_skipped")).orderBy(F.desc("pages_crawled"), "domain").limit(n)


def logs(log: DataFrame, n: int = 100) -> DataFrame:
    return log.orderBy(F.desc("ts"), "message").limit(n)


def judging(pages: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Blocked reasons, field completeness, duplicate methods, html quality, problems, types and skip reasons."""
    meta = T.unwrapped_metadata(F.col("metadata_json"))
    reason = lambda key: F.coalesce(F.get_json_object(meta, f"$.{key}"), F.lit("unknown"))
    count = lambda df, c, name: df.groupBy(c.alias(name)).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), name)
    return {
        "blocked_reasons": count(pages.filter("status = 'blocked'"), reason("blocked_reason"), "reason"), "fields": report.completeness(docs, [f for f in ARTICLE_FIELDS if f in docs.columns]),
        "methods": count(docs, F.coalesce("extraction_method", F.lit("unknown")), "method"), "duplicates": count(pages.filter("is_duplicate = 1"), T.duplicate_method(reason("duplicate_reason"), canonical=True), "method"),
        "html_quality": count(docs, F.coalesce("html_quality", F.lit("unknown")), "html_quality"), "problems": count(docs.select(F.explode("problems_detected").alias("p")), F.col("p"), "problem"),
        "accepted_types": count(pages.filter(report.CLEAN), F.coalesce("page_type", F.lit("unknown")), "page_type"), "skip_reasons": count(pages.filter("status = 'skipped'"), reason("reason"), "reason"),
        "grades": count(docs, T.grade(F.col("quality_score")), "grade"), "tiers": count(docs, F.least("trust_tier", F.lit(5)), "tier") if "trust_tier" in docs.columns else count(docs.limit(0), F.lit(5), "tier"),
    }


def recrawl_stats(schedule: DataFrame, now: Column) -> DataFrame:
    return schedule.agg(F.count("*").alias("scheduled"), F.count_if(F.col("next_crawl") <= now).alias("due"), F.round(F.avg("interval") / 3600, 1).alias("avg_interval_h"), F.coalesce(F.sum("times_changed"), F.lit(0)).alias("changes"))
