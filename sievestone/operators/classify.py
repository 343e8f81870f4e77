"""Page classification and quality scores: native sums over the facts of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.html import facts
from ..functions.urls import query_keys, url_part


def _any(where: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | where.contains(w)
    return out


def url_signals(url: Column) -> list[tuple[str, Column, float]]:
    """(name, whether it holds, weight) of every signal that the url alone gives."""
    path, query, full = F.lower(url_part(url, "path")), F.lower(url_part(url, "query")), F.lower(url)
    keys = query_keys(url_part(url, "query"))
    tracking = F.array(*map(F.lit, C.CLASSIFIER_TRACKING_PARAMS))
    has_slug = F.exists(F.slice(F.reverse(F.filter(F.split(path, "/"), lambda p: p != "")), 1, 1), lambda p: p.rlike(C.SLUG))
    return [
        ("homepage_path", path.rlike("^/?$"), -1.0), ("noise_url_pattern", F.concat(path, F.lit("?"), query).rlike(C.NOISE_PATH), -0.6), ("comment_section_url", path.rlike(C.COMMENT_PATH), -0.7),
        ("pagination_url", path.rlike(r"/page/\d+") | query.rlike(r"[?&](page|paged)=\d+"), -0.8), ("only_tracking_params", (F.size(keys) > 0) & (F.size(F.array_except(keys, tracking)) == 0), -0.5),
        ("financial_url_pattern", path.rlike(C.FINANCIAL_PATH) | full.rlike(C.FINANCIAL_DOMAIN), 0.4), ("educational_url_pattern", path.rlike(C.EDUCATIONAL_PATH) | full.rlike(C.EDUCATIONAL_DOMAIN), 0.35),
        ("longform_url_pattern", path.rlike(C.LONGFORM_PATH), 0.3), ("news_url_pattern", path.rlike(C.NEWS_PATH), 0.35), ("blog_url_pattern", path.rlike(C.BLOG_PATH), 0.3), ("wiki_url_pattern", full.rlike(C.WIKI_PATH), 0.4),
        ("docs_url_pattern", path.rlike(C.DOCS_PATH), 0.35), ("content_url_pattern", path.rlike(C.CONTENT_PATH), 0.2), ("date_in_url", path.rlike(C.DATE_PATH), 0.25), ("article_slug_url", has_slug, 0.2), ("pdf_document", path.endswith(".pdf"), 0.3),
    ]


def html_signals(f: Column) -> list[tuple[Column | str, Column, Column | float]]:
    """The same for a page's facts; a name or weight can depend on the page."""
    words = f.body_words
    types = lambda names: F.arrays_overlap(f.schema_types, F.array(*map(F.lit, names)))
    return [
        ("article_schema_markup", types(C.ARTICLE_SCHEMAS), 0.4), ("financial_schema_markup", types(C.FINANCIAL_SCHEMAS), 0.4), ("educational_schema_markup", types(C.EDUCATIONAL_SCHEMAS), 0.35), ("og_type_article", f.og_type == "article", 0.35),
        ("html_article_tag", f.has_article, 0.3), ("publish_date_tag", f.has_date_tag, 0.2), ("author_markup", f.has_author_markup, 0.15), ("financial_keywords_in_title", f.head_title.rlike(C.FINANCIAL_TITLE), 0.25),
        ("educational_keywords_in_title", f.head_title.rlike(C.EDUCATIONAL_TITLE), 0.2), (F.concat(F.lit("long_form_word_count_"), words.cast("string")), words >= C.LONGFORM_WORDS, F.least(F.lit(0.4), words / 2000)),
        (F.concat(F.lit("word_count_"), words.cast("string")), (words >= 300) & (words < C.LONGFORM_WORDS), F.least(F.lit(0.3), words / 2000)), ("very_low_word_count", words < 50, -0.4), ("good_text_density", f.text_density > 0.15, 0.1),
        ("too_many_links_listing_page", f.n_links > 80, -0.3),
    ]


def classification(url: Column, f: Column | None = None) -> Column:
    """(page_type, is_content_page, confidence, signals, score) of a page, or of its url alone without facts."""
    path, full = F.lower(url_part(url, "path")), F.lower(url)
    found = [*url_signals(url), *(html_signals(f) if f is not None else [])]
    score = sum((F.when(F.coalesce(hit, F.lit(False)), weight).otherwise(0.0) for _, hit, weight in found), F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(hit, F.lit(name) if isinstance(name, str) else name) for name, hit, _ in found]))
    holds = {name: F.coalesce(hit, F.lit(False)) for name, hit, _ in found if isinstance(name, str)}
    words = f.body_words if f is not None else F.lit(0)
    taught = holds.get("educational_schema_markup", F.lit(False)) | holds.get("educational_keywords_in_title", F.lit(False))
    kind = (F.when(path.endswith(".pdf") | _any(full, C.FINANCIAL_URL_WORDS) | (path.rlike(C.FINANCIAL_PATH) & (words > 200)), "financial_tax").when(full.rlike(C.WIKI_PATH), "wiki_page").when(path.rlike(C.DOCS_PATH) | _any(path, C.DOCS_URL_WORDS), "documentation")
            .when(path.rlike(C.EDUCATIONAL_PATH) | full.rlike(C.EDUCATIONAL_DOMAIN) | taught, "educational").when(path.rlike(C.LONGFORM_PATH) | full.rlike(C.LONGFORM_DOMAIN) | (words >= C.LONGFORM_WORDS), "long_form_informational")
            .when(full.rlike(C.BLOG_PATH) | _any(path, C.BLOG_URL_WORDS), "blog_post").when(path.rlike(C.NEWS_PATH) | path.rlike(C.DATE_PATH) | _any(path, C.NEWS_URL_WORDS), "news_article").when(score > 0.3, "article").otherwise("unknown"))
    rejected = holds["homepage_path"] | holds["comment_section_url"] | ((holds["only_tracking_params"] | holds["pagination_url"]) & (score < 0.1))
    content = ~rejected & (((score > 0) & (kind != "unknown")) | (score > 0.4))
    return F.struct(kind.alias("page_type"), content.alias("is_content_page"), F.least(F.greatest((score + 1) / 2, F.lit(0.0)), F.lit(1.0)).alias("confidence"), names.alias("signals"), score.alias("score"))


CLEANLINESS = {"clean": 1.0, "noisy": 0.7}
#: By extraction method, of stored articles (fixed names) and of the ways of functions/maintext.py.
CONFIDENCE = {"trafilatura": 1.0, "readability": 0.75, "bs4_heuristic": 0.5, "density": 1.0, "parents": 0.75, "heuristic": 0.5}


def quality(title: Column, author: Column, date: Column, lang: Column, headings: Column, words: Column, html_quality: Column, problems: Column, method: Column, content: Column, as_of: Column) -> Column:
    """(score, grade, reasons, breakdown) of an article."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    part = lambda hit, w: F.when(hit, w).otherwise(0.0)
    complete = part(has(title), 0.3) + part(has(author), 0.2) + part(has(date), 0.25) + part(has(lang), 0.15) + part(F.coalesce(F.size(headings), F.lit(0)) > 0, 0.1)
    length = F.when(words >= 600, 1.0).when(words >= 300, 0.8).when(words >= 150, 0.5).when(words >= 50, 0.25).otherwise(0.0)
    look = lambda c, table, other: F.coalesce(*[F.when(c == k, v) for k, v in table.items()], F.lit(other))
    clean, sure, fresh = look(html_quality, CLEANLINESS, 0.4), look(method, CONFIDENCE, 0.4), T.freshness_step(date, as_of)
    short = F.length(F.coalesce(content, F.lit(""))) < 100
    raw = F.least(F.greatest(complete * 0.40 + length * 0.25 + clean * 0.15 + fresh * 0.10 + sure * 0.10, F.lit(0.0)), F.lit(1.0))
    score = F.round(F.when(short, F.least(raw, F.lit(0.2))).otherwise(raw), 4)
    listed = F.array_compact(F.array(F.when(~has(title), "missing_title"), F.when(~has(author), "missing_author"), F.when(~has(date), "missing_date"), F.when(words < 50, "too_short"),
                                     F.when((clean == 0.4) & (F.size(problems) > 0), F.concat(F.lit("html_issues:"), F.array_join(F.slice(problems, 1, 3), ","))), F.when(sure == 0.5, "low_confidence_extraction"), F.when(short, "content_too_short")))
    reasons = F.when((F.size(listed) == 0) & (score >= 0.5), F.array(F.lit("good_quality_article"))).otherwise(listed)
    return F.struct(score.alias("score"), T.grade(score).alias("grade"), reasons.alias("reasons"), F.struct(complete.alias("completeness"), length.alias("content_length"), clean.alias("cleanliness"), fresh.alias("freshness"), sure.alias("extraction_confidence")).alias("breakdown"))


def extract(pages: DataFrame, as_of: Column, url: str = "url", html: str = "html") -> DataFrame:
    """pages with the article record of each: facts, language, summary, classification and quality.  The page is parsed once,
    in one UDF; the html column does not go further."""
    f = F.col("_f")
    rows = pages.withColumn("_f", facts(F.col(url), F.coalesce(F.col(html), F.lit("")))).drop(html)
    rows = rows.withColumn("page_classification", classification(F.col(url), f))
    shown = ["canonical_url", "title", "author", "published_date", "headings", "html_quality", "problems_detected", "main_content", "extraction_method"]
    rows = rows.select(*[c for c in rows.columns if c not in shown], *[f[c].alias(c) for c in shown], F.slice(f.images, 1, 3).alias("images")).drop("_f")
    rows = rows.withColumns({"word_count": T.word_count(F.col("main_content")), "language": T.language(F.col("main_content")), "summary": T.summary(F.col("main_content")), "source_domain": url_part(F.col(url), "host"), "content_hash": T.content_hash(F.col("main_content"))})
    q = quality(*[F.col(c) for c in ("title", "author", "published_date", "language", "headings", "word_count", "html_quality", "problems_detected", "extraction_method", "main_content")], as_of)
    rows = rows.withColumn("_q", q)
    return rows.withColumns({"quality_score": F.col("_q.score"), "quality_grade": F.col("_q.grade"), "quality_reasons": F.col("_q.reasons"), "quality_breakdown": F.col("_q.breakdown"), "page_type": F.col("page_classification.page_type"), "is_content": F.col("page_classification.is_content_page").cast("int")}).drop("_q")
