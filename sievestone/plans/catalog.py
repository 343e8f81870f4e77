"""Queries by name over the driver's tables, and for each that SQL can express, SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import classify, dedup, fingerprints, frontier, ranking, report, retrieval, substring
from ..session import materialize, shared_dir, small_side
from ..sources import feeds
from ..streaming import jobs
from . import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Every query that depends on "now" is asked as of this day.
AS_OF = "1998-12-01"


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def strings(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- stand-ins: the events table as a page log, documents as articles ------------------------------------------------
STATUS = {"view": "fetched", "click": "fetched", "purchase": "skipped", "error": "blocked", "signup": "error"}


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))])
    return e.select(F.concat(F.lit("https://d"), F.pmod("user_id", F.lit(20)).cast("string"), F.lit(".example.com/"), F.col("event_id").cast("string")).alias("url"), F.concat(F.lit("d"), F.pmod("user_id", F.lit(20)).cast("string"), F.lit(".example.com")).alias("domain"),
                    F.try_element_at(status, "event_type").alias("status"), (F.col("event_type").isin("view", "click")).cast("int").alias("is_content"), (F.col("event_id") % 7 == 0).cast("int").alias("is_duplicate"), (F.pmod("event_id", F.lit(100)) / 100.0).alias("quality_score"), "ts", "event_id", "user_id")


LOG_SQL = """log AS (SELECT 'https://d' || (user_id % 20) || '.example.com/' || event_id AS url, 'd' || (user_id % 20) || '.example.com' AS domain,
 CASE event_type WHEN 'view' THEN 'fetched' WHEN 'click' THEN 'fetched' WHEN 'purchase' THEN 'skipped' WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'error' END AS status,
 (event_type IN ('view', 'click'))::INT AS is_content, (event_id % 7 = 0)::INT AS is_duplicate, (event_id % 100) / 100.0::DOUBLE AS quality_score, ts, event_id, user_id FROM events)"""
TYPE_SQL = "CASE WHEN source IN ('src0', 'src5') THEN 'news_article' WHEN source IN ('src1', 'src6') THEN 'blog_post' WHEN source IN ('src2', 'src7') THEN 'wiki_page' WHEN source = 'src3' THEN 'documentation' ELSE 'article' END"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("domain"), "n_chars", F.expr(TYPE_SQL).alias("page_type"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("quality_score"), T.word_count(F.col("text")).alias("word_count"))


ART_SQL = f"""art AS (SELECT doc_id, text, lang AS language, source AS domain, n_chars, {TYPE_SQL} AS page_type, least(n_chars / 10000.0::DOUBLE, 1.0) AS quality_score, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count FROM documents)"""


# --- report ----------------------------------------------------------------------------------------------------------
@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(substr(text, 1, 5000)), '[a-z]{{4,}}'), lambda t: t NOT IN ({strings(C.STOP_WORDS)})) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM w), c AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) AS total)
SELECT term, round(tf / total * ln((n + 1) / (df + 1)), 6) AS tfidf_score, df AS doc_frequency, round(df * 100 / n, 1) AS doc_pct, tf AS total_occurrences FROM c, n WHERE df >= 2
ORDER BY tf / total * ln((n + 1) / (df + 1)) DESC, term LIMIT 30""")
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return report.top_terms(table(spark, d, "documents"), "text").withColumn("total_occurrences", F.col("total_occurrences").cast("long"))


_DESCRIBE = "count(n_chars) AS count, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.5), 4) AS median, round(coalesce(stddev_samp(n_chars), 0), 4) AS std, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round(quantile_cont(n_chars, 0.25), 4) AS p25, round(quantile_cont(n_chars, 0.75), 4) AS p75, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25), 4) AS iqr"


@query(f"SELECT lang, {_DESCRIBE} FROM documents GROUP BY lang")
def describe_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return report.describe(table(spark, d, "documents"), "n_chars", "lang")


@query(f"SELECT {_DESCRIBE} FROM documents")
def describe_global(spark: SparkSession, d: str) -> DataFrame:
    return report.describe(table(spark, d, "documents"), "n_chars")


@query("SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("cnt"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


_CLEAN = "is_content = 1 AND is_duplicate = 0"
_GRADES = [("a", "quality_score >= 0.8"), ("b", "quality_score >= 0.65 AND quality_score < 0.8"), ("c", "quality_score >= 0.5 AND quality_score < 0.65"), ("d", "quality_score >= 0.35 AND quality_score < 0.5"), ("f", "quality_score < 0.35")]
_pct = lambda x: f"round(count(*) FILTER ({x}) * 100.0::DOUBLE / greatest(count(*), 1), 1)"


@query(f"""WITH {LOG_SQL} SELECT count(*) AS total_urls, count(*) FILTER ({_CLEAN}) AS clean_articles, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('fetched', 'blocked', 'skipped', 'error'))},
{_pct("status = 'fetched'")} AS success_rate_pct, {_pct("status = 'blocked'")} AS block_rate_pct, {_pct("is_duplicate = 1")} AS duplicate_rate_pct, {_pct("status = 'skipped'")} AS skip_rate_pct, {_pct("status = 'error'")} AS error_rate_pct,
{', '.join(f"count(*) FILTER ({_CLEAN} AND {w}) AS grade_{g}" for g, w in _GRADES)} FROM log""")
def crawl_health(spark: SparkSession, d: str) -> DataFrame:
    return report.crawl_health(page_log(spark, d))


@query(f"""WITH {LOG_SQL}, a AS (SELECT count(*) AS t, count(*) FILTER ({_CLEAN}) AS c, count(*) FILTER (status = 'blocked') AS b, count(*) FILTER (status = 'skipped') AS s, count(*) FILTER (is_duplicate = 1) AS u, sum(quality_score) FILTER ({_CLEAN}) AS q FROM log)
SELECT t AS total_pages, c AS clean_articles, round(c * 100.0::DOUBLE / t, 1) AS yield_rate_pct, round((t - c) * 100.0::DOUBLE / t, 1) AS waste_rate_pct, round(q / t, 4) AS quality_weighted_yield, round(t / c, 2) AS pages_per_article, round((1 - b / t) * 100, 1) AS block_avoidance_pct,
round(b * 100.0::DOUBLE / (t - c), 1) AS blocked_pct, round(s * 100.0::DOUBLE / (t - c), 1) AS skipped_pct, round(u * 100.0::DOUBLE / (t - c), 1) AS duplicate_pct, round((t - c - b - s - u) * 100.0::DOUBLE / (t - c), 1) AS error_pct FROM a""")
def efficiency_metrics(spark: SparkSession, d: str) -> DataFrame:
    return report.efficiency(page_log(spark, d))


@query("""WITH c AS (SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type)
SELECT event_type, cnt, round(cnt * 100.0::DOUBLE / sum(cnt) OVER (), 4) AS pct, round(sum(cnt) OVER (ORDER BY cnt DESC, event_type) * 100.0::DOUBLE / sum(cnt) OVER (), 4) AS running_pct, row_number() OVER (ORDER BY cnt DESC, event_type)::INT AS rank FROM c""")
def pareto_waste(spark: SparkSession, d: str) -> DataFrame:
    return report.pareto(table(spark, d, "events"), "event_type")


@query(f"WITH {ART_SQL} SELECT CASE WHEN quality_score >= 0.8 THEN 'A' WHEN quality_score >= 0.65 THEN 'B' WHEN quality_score >= 0.5 THEN 'C' WHEN quality_score >= 0.35 THEN 'D' ELSE 'F' END AS grade, count(*) AS cnt FROM art GROUP BY 1")
def grade_histogram(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).groupBy(T.grade(F.col("quality_score")).alias("grade")).agg(F.count("*").alias("cnt"))


@query(f"""WITH {ART_SQL}, want(page_type) AS (VALUES {', '.join(f"('{t}')" for t in C.PAGE_TYPES)}), g AS (SELECT page_type, count(*) AS n, avg(quality_score) AS q, avg(word_count) AS w FROM art GROUP BY 1)
SELECT page_type, coalesce(n, 0) AS cnt, round(coalesce(q, 0), 3) AS avg_quality, round(coalesce(w, 0), 0) AS avg_words, coalesce(n, 0) > 0 AS covered FROM want LEFT JOIN g USING (page_type)""")
def page_type_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.coverage(articles(spark, d), "page_type", "quality_score", "word_count")


@query(f"""WITH {ART_SQL}, j AS (SELECT art.*, quality, toxic FROM art LEFT JOIN labels USING (doc_id)),
f AS (SELECT quality_score AS q, unnest([CASE WHEN quality IS NOT NULL THEN 'has_author' ELSE 'no_author' END, CASE WHEN toxic = 0 THEN 'has_date' ELSE 'no_date' END, CASE WHEN word_count < 300 THEN 'short_< 300w' WHEN word_count < 800 THEN 'medium_300-800w' WHEN word_count < 2000 THEN 'long_800-2000w' ELSE 'very_long_> 2000w' END, 'bs4_heuristic']) AS feature FROM j)
SELECT feature, count(*) AS cnt, round(avg(q), 3) AS avg_quality, round(coalesce(stddev_samp(q), 0), 3) AS std FROM f GROUP BY feature""")
def quality_features(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    labels = report.feature_labels(F.when(F.col("quality").isNotNull(), "x"), F.when(F.col("toxic") == 0, "x"), F.col("word_count"), F.lit("heuristic"), F.lit(""))
    return report.feature_quality(rows, labels, F.col("quality_score"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS cnt FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def temporal_monthly(spark: SparkSession, d: str) -> DataFrame:
    return report.by_month(table(spark, d, "orders"), "o_orderdate")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS cnt FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def daily_tail(spark: SparkSession, d: str) -> DataFrame:
    return report.by_day(table(spark, d, "events"), "ts")


_AGE = f"date_diff('day', o_orderdate::DATE, DATE '{AS_OF}')"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


@query(f"SELECT o_orderkey, round(exp(-greatest({_AGE}, 0) / 43.3), 6) AS freshness FROM orders")
def freshness_exp(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("o_orderkey", F.round(T.decay(F.col("date"), as_of(), 0.0), 6).alias("freshness"))


@query(f"SELECT o_orderkey, CASE WHEN {_AGE} < 0 THEN 0.7 WHEN {_AGE} <= 7 THEN 1.0 WHEN {_AGE} <= 30 THEN 0.9 WHEN {_AGE} <= 365 THEN 0.7 WHEN {_AGE} <= 1095 THEN 0.5 ELSE 0.3 END::DOUBLE AS freshness FROM orders")
def freshness_step(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("o_orderkey", T.freshness_step(F.col("date"), as_of()).alias("freshness"))


@query(f"SELECT CASE WHEN {_AGE} <= 1 THEN '< 1 day' WHEN {_AGE} <= 7 THEN '1–7 days' WHEN {_AGE} <= 28 THEN '1–4 weeks' WHEN {_AGE} <= 90 THEN '1–3 months' WHEN {_AGE} <= 365 THEN '3–12 months' ELSE '> 1 year' END AS bucket, count(*) AS cnt FROM orders GROUP BY 1")
def freshness_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).groupBy(T.freshness_bucket(T.age_days(F.col("date"), as_of())).alias("bucket")).agg(F.count("*").alias("cnt"))


@query(f"""WITH {LOG_SQL}, {ART_SQL}, a2 AS (SELECT *, 'd' || substr(domain, 4) || '.example.com' AS dom FROM art), l AS (SELECT domain, count(*) AS pages, count(*) FILTER (status = 'blocked') AS blocked FROM log GROUP BY 1),
m AS (SELECT dom, page_type, count(*) AS n FROM a2 GROUP BY ALL), m1 AS (SELECT dom, page_type FROM m QUALIFY row_number() OVER (PARTITION BY dom ORDER BY n DESC, page_type) = 1), m2 AS (SELECT dom, language FROM (SELECT dom, language, count(*) AS n FROM a2 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dom ORDER BY n DESC, language) = 1),
g AS (SELECT dom, count(*) AS articles, avg(quality_score) FILTER (quality_score <> 0) AS q, avg(word_count) AS w FROM a2 GROUP BY 1)
SELECT l.domain, pages, coalesce(articles, 0) AS articles, round(blocked / pages * 100, 1) AS block_rate_pct, round(coalesce(articles, 0) * 100.0::DOUBLE / pages, 1) AS yield_pct, round(coalesce(q, 0), 4) AS avg_quality, round(coalesce(w, 0), 1) AS avg_words, page_type, language,
round(0.4 * coalesce(q, 0) + 0.3 * (coalesce(articles, 0) / pages) + 0.2 * least(ln(1 + pages) / ln(501), 1) + 0.1 * (1 - blocked / pages), 4) AS domain_score FROM l LEFT JOIN g ON l.domain = g.dom LEFT JOIN m1 ON m1.dom = l.domain LEFT JOIN m2 ON m2.dom = l.domain""")
def domain_profiles(spark: SparkSession, d: str) -> DataFrame:
    docs = articles(spark, d).withColumn("domain", F.concat(F.lit("d"), F.substr("domain", F.lit(4)), F.lit(".example.com")))
    return report.domain_profiles(page_log(spark, d), docs)


@query("""WITH dom AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages), x AS (SELECT domain FROM dom)
SELECT domain, count(url) AS pages FROM x LEFT JOIN pages ON contains(lower(url), lower(domain)) GROUP BY domain""")
def domain_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Every domain with the number of pages whose url contains it anywhere."""
    pages = table(spark, d, "pages").select("url")
    return substring.containing(pages, "url", pages.select(U.url_part(F.col("url"), "host").alias("domain")), "domain").withColumnRenamed("hits", "pages")


@query(f"WITH {ART_SQL} SELECT language, count(*) AS cnt FROM art GROUP BY 1 ORDER BY cnt DESC, language LIMIT 20")
def language_top(spark: SparkSession, d: str) -> DataFrame:
    return report.top_counts(articles(spark, d), "language", 20)


@query(f"WITH {ART_SQL} SELECT 'text' AS field, count(*) FILTER (coalesce(text, '') <> '') AS cnt, {_pct("coalesce(text, '') <> ''")} AS pct FROM art UNION ALL SELECT 'language', count(*) FILTER (coalesce(language, '') <> ''), {_pct("coalesce(language, '') <> ''")} FROM art")
def field_completeness(spark: SparkSession, d: str) -> DataFrame:
    return report.completeness(articles(spark, d), ["text", "language"])


@query("SELECT source, lang, cnt FROM (SELECT source, lang, count(*) AS cnt FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY cnt DESC, lang) = 1")
def mode_by_source(spark: SparkSession, d: str) -> DataFrame:
    m = report.mode_of(table(spark, d, "documents"), "source", "lang")
    return m.select("source", "lang", F.element_at("mix", F.col("lang")).alias("cnt"))


@query(f"""WITH {LOG_SQL}, d AS (SELECT url, 'https://d' || (event_id % 5) || '.example.com/' AS of FROM log WHERE is_duplicate = 1)
SELECT of, count(*) AS size FROM d GROUP BY of ORDER BY size DESC, of LIMIT 10""")
def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    log = page_log(spark, d).withColumn("duplicate_of", F.concat(F.lit("https://d"), F.pmod("event_id", F.lit(5)).cast("string"), F.lit(".example.com/")))
    return dedup.duplicate_clusters(log).select("of", "size")


# --- urls ------------------------------------------------------------------------------------------------------------
@query(f"""WITH p AS (SELECT page_id, lower(trim(url)) AS u FROM pages), s AS (SELECT page_id, regexp_extract(u, '^([a-z]+://[^/?#]*)', 1) AS head, rtrim(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(u, '\\?([^#]*)', 1) AS q FROM p),
k AS (SELECT page_id, string_agg(kv, '&' ORDER BY split_part(kv, '=', 1)) AS q FROM (SELECT page_id, unnest(string_split(q, '&')) AS kv FROM s) WHERE split_part(kv, '=', 2) <> '' AND split_part(kv, '=', 1) NOT IN ({strings(C.TRACKING_PARAMS)}) GROUP BY page_id)
SELECT s.page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN k.q IS NULL THEN '' ELSE '?' || k.q END AS norm_url FROM s LEFT JOIN k USING (page_id)""")
def normalize_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm_url"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/amp/|[?&]amp=1|\.amp\.html$|/amp$') THEN 'amp_url' WHEN regexp_matches(url, '(?i)/print(/|$)|[?&]print=1|/printable/') THEN 'print_url' WHEN regexp_matches(url, '(?i)^https?://(m|mobile)\.') THEN 'mobile_url' END AS variant FROM pages")
def url_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.url_variant(F.col("url")).alias("variant"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, '?' || regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, CASE WHEN regexp_matches(q, '(?i)[?&](q|s|search|query|keyword|k|term|text)=') THEN 'search_result_url' WHEN regexp_matches(path, '(?i)/(load-more|infinite|next-page|ajax|api/posts|feed\.json)') THEN 'infinite_scroll_or_ajax_endpoint'
WHEN regexp_matches(lower(url), '[?&]comment[_-]?page=|#comment|/comment[s]?/page/') THEN 'comment_pagination' WHEN try_cast(regexp_extract(q, '(?i)[?&](page|p|pg|paged|start|offset|from|skip)=(\d+)', 2) AS BIGINT) > 30 THEN 'pagination_depth_too_high_' || regexp_extract(q, '(?i)[?&](page|p|pg|paged|start|offset|from|skip)=(\d+)', 2)
WHEN regexp_matches(path, '/\d{4}/\d{2}/(\d{2}/)?$|(?i)/archive/\d{4}|/\d{4}/$') THEN 'calendar_or_archive_url' END AS reason FROM p""")
def trap_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.trap_reason(F.col("url")).alias("reason"))


_TIERS = ", ".join(f"('{dom}', {score}::DOUBLE, '{cat}', {tier})" for dom, score, cat, tier in C.TRUST_TIERS)
_KNOWN = ["bloomberg.com", "www.wsj.com", "sub.finance.yahoo.com", "news.sec.gov", "medium.com"]


@query(f"""WITH t(dom, score, category, tier) AS (VALUES {_TIERS}), p AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ELSE list_extract([{strings(_KNOWN)}], (page_id % 6)::INT) END AS host FROM pages),
h AS (SELECT page_id, regexp_replace(lower(host), '^www\\.', '') AS host FROM p), j AS (SELECT page_id, t.* FROM h JOIN t ON host = dom OR ends_with(host, '.' || dom) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(dom) DESC) = 1)
SELECT h.page_id, CASE WHEN dom IS NOT NULL THEN score WHEN contains(host, 'sec.gov') THEN 1.0 ELSE 0.3 END AS score, coalesce(category, 'unknown') AS category, coalesce(tier, 5) AS tier FROM h LEFT JOIN j USING (page_id)""")
def trust_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = F.element_at(F.array(*map(F.lit, _KNOWN)), F.greatest(F.pmod("page_id", F.lit(6)), F.lit(1)).cast("int"))
    url = F.when(F.pmod("page_id", F.lit(6)) == 0, F.col("url")).otherwise(F.concat(F.lit("https://"), known, F.lit("/x")))
    t = U.trust(url)
    return table(spark, d, "pages").select("page_id", t.score.alias("score"), t.category.alias("category"), t.tier.alias("tier"))


@query("SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', -2) || '.' || split_part(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', -1) AS domain FROM pages")
def registered_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.registered_domain(U.url_part(F.col("url"), "host")).alias("domain"))


# --- frontier and set operations -------------------------------------------------------------------------------------
@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return frontier.latest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "ts")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return frontier.first_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("o")), "user_id", "o").select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def frontier_topk(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return frontier.next_round(queue, 50).select(F.col("id").alias("o_orderkey"), F.col("priority").alias("o_totalprice"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def seen_anti(spark: SparkSession, d: str) -> DataFrame:
    return frontier.unseen(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), key="c_custkey")


@query("SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query(f"WITH {LOG_SQL} SELECT event_id, url, ts FROM log WHERE {_CLEAN} ORDER BY ts DESC, event_id LIMIT 20")
def recent_articles(spark: SparkSession, d: str) -> DataFrame:
    return page_log(spark, d).filter(_CLEAN).orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "url", "ts")


@query("""WITH s AS (SELECT page_id, url, page_id % 10 / 10.0::DOUBLE AS priority, page_id % 3 = 0 AS is_news, list_extract(['daily', 'weekly', 'hourly', ''], (page_id % 4)::INT + 1) AS changefreq, CASE WHEN page_id % 2 = 0 THEN '2024-01-01' ELSE '' END AS lastmod FROM pages)
SELECT page_id, round(priority + CASE WHEN is_news THEN 0.5 ELSE 0 END + CASE WHEN changefreq IN ('hourly', 'daily') THEN 0.2 ELSE 0 END + CASE WHEN lastmod <> '' THEN 0.1 ELSE 0 END, 6) AS score FROM s""")
def sitemap_priority(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    made = p.select("page_id", "url", F.col("page_id").alias("ord"), (F.pmod("page_id", F.lit(10)) / 10.0).alias("priority"), (F.pmod("page_id", F.lit(3)) == 0).alias("is_news"), F.element_at(F.array(*map(F.lit, ("daily", "weekly", "hourly", ""))), (F.pmod("page_id", F.lit(4)) + 1).cast("int")).alias("changefreq"), F.when(F.pmod("page_id", F.lit(2)) == 0, "2024-01-01").otherwise("").alias("lastmod"))
    return frontier.prioritized(made).select("page_id", "score")


@query("SELECT page_id, url FROM pages WHERE NOT starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/de/')")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    hosts = p.select(U.url_part(F.col("url"), "host").alias("host")).distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /de/\nSitemap: https://example.com/sitemap.xml"))
    return frontier.allowed(p, feeds.robots_rules(hosts))


@query("""WITH o AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch(ts)::DOUBLE, event_type) AS was FROM events)
SELECT user_id, max(t) AS last_crawled, count(*) FILTER (was IS NOT NULL AND was <> event_type) AS times_changed, count(*) FILTER (was = event_type) AS times_unchanged FROM o GROUP BY user_id""")
def recrawl_history(spark: SparkSession, d: str) -> DataFrame:
    return frontier.recrawl_fold(table(spark, d, "events"), "user_id", "ts", "event_type").select("user_id", "last_crawled", "times_changed", "times_unchanged")


@query(f"""WITH o AS (SELECT user_id, epoch(ts)::DOUBLE AS t, event_type, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts)::DOUBLE, event_type)),
g AS (SELECT user_id, max(t) AS last_crawled, list((was <> event_type)::INT::DOUBLE ORDER BY t, event_type) FILTER (was IS NOT NULL) AS steps, count(*) FILTER (was <> event_type) AS times_changed, count(*) FILTER (was = event_type) AS times_unchanged FROM o GROUP BY user_id),
f AS (SELECT *, list_reduce(list_concat([{C.DEFAULT_INTERVAL}::DOUBLE], coalesce(steps, []::DOUBLE[])), lambda i, x: CASE WHEN x = 1 THEN greatest(i / {C.INTERVAL_FACTOR}::DOUBLE, {C.MIN_INTERVAL}::DOUBLE) ELSE least(i * {C.INTERVAL_FACTOR}::DOUBLE, {C.MAX_INTERVAL}::DOUBLE) END) AS i FROM g)
SELECT user_id, last_crawled, round(i, 4) AS interval, round(last_crawled + i, 4) AS next_crawl, times_changed, times_unchanged FROM f""")
def recrawl_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows = frontier.recrawl_fold(table(spark, d, "events"), "user_id", "ts", "event_type")
    return rows.withColumns({c: F.round(c, 4) for c in ("interval", "next_crawl")})


@query()
def reachable_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    links = crawl.outlinks(pages, domains=["example.com", "example.net", "example.org"])
    return frontier.reachable(pages.select("url").orderBy("page_id").limit(20), links, 2, 15)


# --- duplicates ------------------------------------------------------------------------------------------------------
_HASH = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"


@query(f"WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_HASH}) AS first FROM documents WHERE length(trim(text)) >= 50) SELECT doc_id, first FROM h WHERE doc_id > first")
def content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT {_HASH} AS content_hash, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("size"), F.min("doc_id").alias("first")).filter("size > 1")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))


_TITLE_SQL = "t AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(trim(lower(split_part(text, chr(10), 1))), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')) AS w FROM documents WHERE length(split_part(text, chr(10), 1)) > 10)"


@query(f"WITH {_TITLE_SQL}, j AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS n, len(y.w) AS m FROM t x JOIN t y ON x.doc_id < y.doc_id AND len(x.w) > 0 AND len(y.w) >= 0.9 * len(x.w) AND len(x.w) >= 0.9 * len(y.w)) SELECT a, b, round(i / (n + m - i), 6) AS similarity FROM j WHERE i / (n + m - i) >= 0.9")
def title_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.title_pairs(_titles(spark, d), "doc_id", "title").withColumn("similarity", F.round("similarity", 6))


_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(substr(text, 1, 8000)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_SIM_SQL = f"""w AS (SELECT doc_id, {_TOKENS} AS w FROM documents), tok AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS t FROM w),
h AS (SELECT doc_id, ('0x' || substr(md5(t), 17, 16))::UBIGINT AS h FROM tok), v AS (SELECT doc_id, b, sum(((h >> b) & 1)::INT * 2 - 1) AS s FROM h, (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY ALL),
s AS (SELECT doc_id, bit_or(CASE WHEN s > 0 THEN 1::UHUGEINT << b::UHUGEINT ELSE 0::UHUGEINT END)::UBIGINT AS u FROM v GROUP BY doc_id)"""


@query(f"WITH {_SIM_SQL} SELECT d.doc_id, lpad(lower(to_hex(coalesce(u, 0::UBIGINT))), 16, '0') AS simhash FROM documents d LEFT JOIN s USING (doc_id)")
def simhash64(spark: SparkSession, d: str) -> DataFrame:
    return T.simhash(table(spark, d, "documents"), "doc_id", "text").select("doc_id", T.simhash_hex(F.col("simhash")).alias("simhash"))


def _whole_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, simhash) of whole texts, of which so many go to Python at a time."""
    return materialize(T.simhash(docs, "doc_id", "text", head=None), T.TEXTS)


@query(f"WITH {_SIM_SQL} SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.u, y.u))::INT AS distance FROM s x JOIN s y ON x.doc_id < y.doc_id AND bit_count(xor(x.u, y.u)) <= 3")
def simhash_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose whole texts have near fingerprints."""
    return dedup.simhash_pairs(_whole_prints(table(spark, d, "documents")), "doc_id", distance=3)


@query(f"WITH {_SIM_SQL} SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.u, y.u))::INT AS distance FROM s x JOIN s y ON x.doc_id < y.doc_id AND bit_count(xor(x.u, y.u)) <= {dedup.DISTANCE}")
def simhash_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at the distance that makes a duplicate, by whole texts."""
    return dedup.simhash_pairs(_whole_prints(table(spark, d, "documents")), "doc_id")


@query(f"""WITH {_SIM_SQL}, f AS (SELECT doc_id, coalesce(u, 0::UBIGINT) AS u FROM documents LEFT JOIN s USING (doc_id)), c AS (SELECT u, min(doc_id) AS class_id, count(*) AS copies FROM f GROUP BY u),
l AS (SELECT x.u, count(*) AS links FROM c x JOIN c y ON x.u <> y.u AND bit_count(xor(x.u, y.u)) <= {dedup.DISTANCE} GROUP BY x.u) SELECT doc_id, class_id, copies, coalesce(links, 0) AS links FROM f JOIN c USING (u) LEFT JOIN l USING (u)""")
def fingerprint_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents by classes of equal fingerprints of whole texts and the links of those, from an index that gets the English ones first and then the rest."""
    docs = table(spark, d, "documents")
    hashes = materialize(_whole_prints(docs).join(docs.select("doc_id", "lang"), "doc_id"))
    index = fingerprints.FingerprintIndex.open(spark, shared_dir(spark), f"fingerprints_{uuid.uuid4().hex}", hashes.count())
    english = F.col("lang").eqNullSafe("en")
    for number, part in enumerate((hashes.filter(english), hashes.filter(~english))):
        index.add(part, number, "doc_id", "simhash")
    found = materialize(hashes.select("doc_id", F.col("simhash").alias("fingerprint")).join(index.classes(), "fingerprint").select("doc_id", "class_id", "copies", "links"))
    index.drop()
    return found


@query("""WITH x AS (SELECT event_id, list_extract(['near_duplicate_simhash_0.91', 'title_similarity_0.95', 'canonical_url_match', 'normalized_url_match', 'amp_url', 'print_url', 'mobile_url', 'exact_content_hash', 'other'], (event_id % 9)::INT + 1) AS r FROM events)
SELECT CASE WHEN contains(r, 'simhash') THEN 'SimHash near-duplicate' WHEN contains(r, 'title') THEN 'Title similarity' WHEN contains(r, 'canonical') OR contains(r, 'normalized') THEN 'URL normalization' WHEN contains(r, 'amp') THEN 'AMP variant' WHEN contains(r, 'print') THEN 'Print variant'
WHEN contains(r, 'mobile') THEN 'Mobile variant' WHEN contains(r, 'hash') THEN 'Exact content hash' ELSE r END AS method, count(*) AS cnt FROM x GROUP BY 1""")
def reason_bucket(spark: SparkSession, d: str) -> DataFrame:
    names = ["near_duplicate_simhash_0.91", "title_similarity_0.95", "canonical_url_match", "normalized_url_match", "amp_url", "print_url", "mobile_url", "exact_content_hash", "other"]
    reason = F.element_at(F.array(*map(F.lit, names)), (F.pmod("event_id", F.lit(9)) + 1).cast("int"))
    return table(spark, d, "events").groupBy(T.duplicate_method(reason).alias("method")).agg(F.count("*").alias("cnt"))


@query()
def layered_dedup(spark: SparkSession, d: str) -> DataFrame:
    pages = materialize(classify.extract(table(spark, d, "pages"), as_of()), H.PAGES)
    return dedup.layered(pages, "page_id")


# --- ranking ---------------------------------------------------------------------------------------------------------
_RANK_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{3,}}}}'), lambda w: w NOT IN ({strings(C.RANKING_STOP_WORDS)}))"


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct({_RANK_TOKENS.format('text')})) AS term FROM documents) SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM t GROUP BY term HAVING count(*) >= 5")
def idf_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return ranking.vocabulary(table(spark, d, "documents"), "doc_id", "text").filter("df >= 5").select("term", "df", F.round("idf", 6).alias("idf"))


_VEC = "SELECT k, term, c * coalesce(idf, ln(100)) / sqrt(sum((c * coalesce(idf, ln(100))) ** 2) OVER (PARTITION BY k)) AS w FROM (SELECT k, term, count(*) AS c FROM {} GROUP BY ALL) LEFT JOIN idf USING (term)"


@query(f"""WITH d AS (SELECT doc_id AS k, unnest({_RANK_TOKENS.format('text')}) AS term FROM documents), q AS (SELECT item_id AS k, unnest({_RANK_TOKENS.format('text')}) AS term FROM benchmark),
idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT k) + 1)) + 1 AS idf FROM d GROUP BY term), dv AS ({_VEC.format('d')}), qv AS ({_VEC.format('q')}),
c AS (SELECT qv.k AS item_id, dv.k AS doc_id, round(sum(qv.w * dv.w), 6) AS cosine FROM qv JOIN dv USING (term) GROUP BY ALL) SELECT item_id, doc_id, cosine FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) <= 5""")
def query_doc_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest documents of every benchmark item, against all documents."""
    found = retrieval.search(retrieval.build(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "benchmark"), "item_id", "text", 5)
    return found.select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), F.col("score").alias("cosine"))


_ASKED = "the nation on the other hand"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4)))"
_JACCARD = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END"


@query(f"""WITH r AS (SELECT doc_id, coalesce(split_part(text, chr(10), 1), '') AS t, coalesce(text, '') AS b FROM documents), v AS (SELECT b FROM r UNION ALL SELECT '{_ASKED}'),
idf AS (SELECT term, ln(((SELECT count(*) FROM v) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(list_distinct({_RANK_TOKENS.format('b')})) AS term FROM v) GROUP BY term),
d AS (SELECT doc_id AS k, unnest({_RANK_TOKENS.format("repeat(t || ' ', 3) || substr(b, 1, 5000)")}) AS term FROM r), q AS (SELECT 0 AS k, unnest({_RANK_TOKENS.format(f"'{_ASKED}'")}) AS term), dv AS ({_VEC.format('d')}), qv AS ({_VEC.format('q')}),
c AS (SELECT dv.k AS doc_id, sum(qv.w * dv.w) AS cosine FROM qv JOIN dv USING (term) GROUP BY ALL), n AS (SELECT doc_id, regexp_replace(lower(substr(b, 1, 1000)), '\\s+', ' ', 'g') AS lb, regexp_replace(lower(t), '\\s+', ' ', 'g') AS lt FROM r),
g AS (SELECT doc_id, {_GRAMS.format('lb')} AS gb, {_GRAMS.format('lt')} AS gt, {_GRAMS.format(f"'{_ASKED}'")} AS gq FROM n), j AS (SELECT doc_id, {_JACCARD.format('gq', 'gb')} AS jaccard, {_JACCARD.format('gq', 'gt')} AS title_match FROM g)
SELECT doc_id, round(coalesce(cosine, 0), 6) AS cosine, round(jaccard, 6) AS jaccard, round(title_match, 6) AS title_match, round(least(coalesce(cosine, 0) * 0.5 + jaccard * 0.2 + title_match * 0.3, 1), 6) AS combined FROM j LEFT JOIN c USING (doc_id)""")
def semantic_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")
    ranked = ranking.rank(docs, _ASKED, "doc_id", "title", "text", head=None, lead=None)
    return ranked.select("doc_id", *[F.round(c, 6).alias(c) for c in ("cosine", "jaccard", "title_match", "combined")])


@query("""WITH g AS (SELECT item_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM benchmark), n AS (SELECT item_id, list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS g FROM g)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))), 6) AS jaccard FROM n x JOIN n y ON y.item_id = x.item_id + 1""")
def char_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "benchmark").select("item_id", T.char_ngrams(F.col("text")).alias("g"))
    pair = g.toDF("a", "ga").join(g.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("g").alias("gb")), "a")
    return pair.select("a", "b", F.round(T.jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(substr(text, 1, 5000)), '[a-z]{{4,}}'), lambda t: t NOT IN ({strings(C.STOP_WORDS)})) AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term FROM w),
c AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) AS total),
top AS (SELECT term FROM c, n WHERE df >= 2 ORDER BY tf / total * ln((n + 1) / (df + 1)) DESC, term LIMIT 20), s AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM documents) JOIN top USING (term)), z AS (SELECT term, count(*) AS n FROM s GROUP BY term),
p AS (SELECT x.term AS a, y.term AS b, count(*) AS n_both FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL)
SELECT a, b, round(n_both / (za.n + zb.n - n_both), 6) AS jaccard FROM p JOIN z za ON za.term = a JOIN z zb ON zb.term = b WHERE n_both / (za.n + zb.n - n_both) >= 0.4""")
def topic_term_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return report.term_pairs(docs, "doc_id", "text", report.top_terms(docs, "text", 20), 0.4)


#: A pass over keys k in order; pairs(a, b) are those that are near.  $0: the key's type.
_LEAD_SQL = """h AS (SELECT o.k, row_number() OVER (ORDER BY o.k) AS n, coalesce((SELECT list(a) FROM pairs WHERE b = o.k), []) AS near FROM keys o),
lead AS (SELECT 0::BIGINT AS n, NULL::{0} AS k, []::{0}[] AS leads, NULL::{0} AS leader UNION ALL SELECT h.n, h.k, CASE WHEN len(list_intersect(lead.leads, h.near)) = 0 THEN list_append(lead.leads, h.k) ELSE lead.leads END, coalesce(list_min(list_intersect(lead.leads, h.near)), h.k) FROM lead JOIN h ON h.n = lead.n + 1)"""


@query(ORACLES["topic_term_pairs"].replace("WITH w AS", "WITH RECURSIVE w AS", 1).replace("\nSELECT a, b, round(", ",\nkeys AS (SELECT term AS k FROM top), pairs AS (SELECT a, b FROM (SELECT a, b, round(", 1) + f")), {_LEAD_SQL.format('VARCHAR')} SELECT k AS term, leader FROM lead WHERE n > 0")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    terms = materialize(report.top_terms(docs, "text", 20))
    return ranking.leader_clusters(terms.select("term"), report.term_pairs(docs, "doc_id", "text", terms, 0.4), "term")


@query(f"""WITH RECURSIVE d AS (SELECT item_id AS k, unnest({_RANK_TOKENS.format('text')}) AS term FROM benchmark), idf AS (SELECT term, ln(((SELECT count(*) FROM benchmark) + 1) / (count(DISTINCT k) + 1)) + 1 AS idf FROM d GROUP BY term), dv AS ({_VEC.format('d')}),
pairs AS (SELECT x.k AS a, y.k AS b FROM dv x JOIN dv y ON x.term = y.term AND x.k < y.k GROUP BY ALL HAVING sum(x.w * y.w) >= 0.35), keys AS (SELECT DISTINCT item_id AS k FROM benchmark), {_LEAD_SQL.format('BIGINT')} SELECT k AS item_id, leader FROM lead WHERE n > 0""")
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    return ranking.leader_clusters(items, ranking.similar_pairs(items, "item_id", "text", 0.35), "item_id")


_NEWS = [
    (1, "Acme shares rally", "shares rally and surge despite risk"), (2, "Board approves dividend and merger today", "The board approved a dividend and a merger"), (3, "", ""), (4, "Revenue of $3,000 grew", "revenue of $3,000 and a 5.5% increase; analyst upgrade"),
    (5, "Plunge", "a crash, a plunge and heavy loss after the investigation and a lawsuit"), (6, "Federal reserve holds interest rate", "The federal reserve kept the interest rate; inflation and jobs report next"), (7, "Home", "nothing to see"), (8, "Market outlook for the coming quarter", "strong growth, record profit, weak demand and recession risk"),
]
_NEWS_SQL = "news(id, title, body) AS (VALUES " + ", ".join(f"({i}, '{t}', '{b}')" for i, t, b in _NEWS) + "), n AS (SELECT id, title, body FROM news UNION ALL SELECT doc_id + 1000, split_part(text, chr(10), 1), text FROM documents)"


def _news(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    return spark.createDataFrame(_NEWS, "id long, title string, body string").unionByName(docs)


@query(f"""WITH {_NEWS_SQL}, w AS (SELECT id, list_distinct(regexp_extract_all(lower(title || ' ' || substr(body, 1, 3000)), '[a-z]+')) AS w FROM n), c AS (SELECT id, len(list_intersect(w, [{strings(C.BULLISH)}])) AS p, len(list_intersect(w, [{strings(C.BEARISH)}])) AS m FROM w),
s AS (SELECT id, CASE WHEN p + m > 0 THEN (p - m) / (p + m) ELSE 0 END AS s FROM c) SELECT id, CASE WHEN s > 0.1 THEN 'bullish' WHEN s < -0.1 THEN 'bearish' ELSE 'neutral' END AS label, round(s, 3) AS score FROM s""")
def sentiment(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentiment(F.col("body"), F.col("title"))
    return _news(spark, d).select("id", s.label.alias("label"), F.round(s.score, 3).alias("score"))


@query("WITH " + _NEWS_SQL + ", s AS (SELECT id, substr(body, 1, 5000) AS b FROM n) SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(b, '(?i){p}') THEN '{k}' END" for p, k in C.SIGNALS) + "], lambda x: x IS NOT NULL))), ','), '') AS signals FROM s")
def signals(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).select("id", F.array_join(T.signals(F.col("body")), ",").alias("signals"))


_TERMS = T.query_terms(T.expand_query("interest rate outlook"))
_hits = lambda where: " + ".join(f"contains({where}, '{t}')::INT" for t in _TERMS)


@query(f"WITH {_NEWS_SQL}, x AS (SELECT id, lower(title) AS t, lower(title) || ' ' || lower(substr(body, 1, 2000)) AS b, title, body FROM n) SELECT id, CASE WHEN title = '' AND body = '' THEN 0 ELSE round(least(0.7 * ({_hits('b')}) / {len(_TERMS)} + 0.3 * ({_hits('t')}) / {len(_TERMS)}, 1), 3) END::DOUBLE AS relevance FROM x")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).select("id", F.round(T.relevance(F.col("body"), F.col("title"), _TERMS), 3).cast("double").alias("relevance"))


@query(f"WITH {_NEWS_SQL} SELECT id, NOT regexp_matches(trim(title), '{C.NAVIGATION_TITLE}') AND (len(list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda w: w <> '')) >= 5 OR length(trim(title)) >= 35) AS is_article FROM n")
def article_titles(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).select("id", T.looks_like_article_title(F.col("title")).alias("is_article"))


@query("SELECT doc_id, round(0.4 * 0.3 + 0.3 * least(n_chars / 10000.0, 1) + 0.2 * (doc_id % 10) / 10.0 + 0.1 * 0.3, 6) AS combined FROM documents ORDER BY combined DESC, doc_id LIMIT 100")
def combined_rank(spark: SparkSession, d: str) -> DataFrame:
    score = T.combined_score(F.lit(0.3), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)), F.pmod("doc_id", F.lit(10)) / 10.0, F.lit(0.3))
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("combined")).orderBy(F.desc("combined"), "doc_id").limit(100)


# --- json, pages, streams --------------------------------------------------------------------------------------------
@query("SELECT (props->>'$.k')::BIGINT AS k, count(*) AS cnt FROM events GROUP BY 1")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    doubled = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("props").alias("metadata_json")))).otherwise(F.col("props"))
    return table(spark, d, "events").groupBy(F.get_json_object(T.unwrapped_metadata(doubled), "$.k").cast("long").alias("k")).agg(F.count("*").alias("cnt"))


@query("SELECT page_id, CASE WHEN contains(lower(html), 'id=\"root\"') OR contains(lower(html), 'id=\"app\"') OR contains(lower(html), 'data-reactroot') OR contains(lower(html), '_next/static') OR contains(lower(html), '__next_data__') THEN 'react' WHEN contains(lower(html), 'ng-version') OR contains(lower(html), 'ng-app') OR contains(lower(html), 'angular.min.js') THEN 'angular' WHEN contains(lower(html), '__vue__') OR contains(lower(html), 'vue.min.js') OR contains(lower(html), 'nuxt') THEN 'vue' WHEN contains(lower(html), '__svelte') OR contains(lower(html), 'svelte-') THEN 'svelte' WHEN contains(lower(html), 'ember-view') OR contains(lower(html), 'ember-application') THEN 'ember' ELSE '' END AS framework FROM pages")
def js_frameworks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.js_framework(F.col("html")).alias("framework"))


@query("""WITH s AS (SELECT page_id, list_extract([200, 403, 429, 503, 401, 404, 500], (page_id % 7)::INT + 1) AS status, CASE WHEN page_id % 2 = 0 THEN 'cloudflare' ELSE 'nginx' END AS server, html FROM pages)
SELECT page_id, CASE WHEN status = 403 THEN 'http_403_forbidden' WHEN status = 429 THEN 'rate_limited_429' WHEN status = 503 AND server = 'cloudflare' THEN 'cloudflare_503' WHEN status = 503 THEN 'service_unavailable_503' WHEN status = 401 THEN 'requires_auth_401' WHEN status >= 400 THEN 'http_error_' || status WHEN length(trim(html)) < 200 THEN 'suspiciously_empty_response' ELSE '' END AS reason, status IN (429) OR (status = 503 AND server <> 'cloudflare') OR (status = 200 AND length(trim(html)) < 200) AS should_retry FROM s""")
def block_detection(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 403, 429, 503, 401, 404, 500))), (F.pmod("page_id", F.lit(7)) + 1).cast("int"))
    b = T.block_status(status, F.col("html"), F.when(F.pmod("page_id", F.lit(2)) == 0, "cloudflare").otherwise("nginx"))
    return table(spark, d, "pages").select("page_id", b.reason.alias("reason"), b.should_retry.alias("should_retry"))


@query()
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return materialize(classify.extract(table(spark, d, "pages"), as_of()), H.PAGES)


@query()
def main_text(spark: SparkSession, d: str) -> DataFrame:
    """The main text of every page and the way that found it."""
    f = H.facts(F.col("url"), F.coalesce("html", F.lit("")))
    return materialize(table(spark, d, "pages").withColumn("f", f).select("page_id", F.col("f.extraction_method").alias("extraction_method"), F.col("f.main_content").alias("main_content"), T.word_count(F.col("f.main_content")).alias("word_count")), H.PAGES)


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return materialize(table(spark, d, "pages").select("page_id", H.markdown(F.col("url"), F.col("html")).alias("markdown")), H.PAGES)


@query()
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return crawl.outlinks(table(spark, d, "pages"))


@query()
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    return materialize(table(spark, d, "pages").select("page_id", classify.classification(F.col("url"), H.facts(F.col("url"), F.col("html"))).alias("c")).select("page_id", "c.*"), H.PAGES)


@query()
def classify_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", classify.classification(F.col("url")).alias("c")).select("page_id", "c.*")


@query()
def crawl_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return crawl.crawled(table(spark, d, "pages"), as_of())


def _made_articles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/a")).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("main_content"), F.lit("1998-11-01").alias("published_date"), T.word_count(F.col("text")).alias("word_count"), F.lit(0.8).alias("quality_score"))


@query()
def research_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return crawl.research(_made_articles(spark, d), "tion and here", as_of())


@query()
def research_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ranking.research_rollup(crawl.scored(_made_articles(spark, d), "tion and here", as_of()))


@query()
def analytics_report(spark: SparkSession, d: str) -> DataFrame:
    log = page_log(spark, d).withColumn("reason", F.lit("exact_content_hash"))
    docs = articles(spark, d).withColumn("domain", F.concat(F.lit("d"), F.substr("domain", F.lit(4)), F.lit(".example.com")))
    docs = docs.withColumns({"main_content": F.col("text"), "author": F.lit(""), "published_date": F.lit("1998-11-01"), "extraction_method": F.lit("heuristic"), "html_quality": F.lit("clean"), "problems_detected": F.array(F.lit("missing_author"))})
    return feeds.json_report(report.full_report(log, docs))


@query()
def seed_urls(spark: SparkSession, d: str) -> DataFrame:
    return feeds.seeds(spark, "Fed interest rate and tax filing")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..session import shared_dir

    base = shared_dir(spark)
    rows = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*events*.parquet" if not _is_folder(spark, f"{d}/events.parquet") else "*.parquet").parquet(d if not _is_folder(spark, f"{d}/events.parquet") else f"{d}/events.parquet")
    out = jobs.drained(jobs.daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "3650 days"), f"{base}/out", f"{base}/state", "update")
    return out.groupBy("day", "event_type").agg(F.max_by("cnt", "batch").alias("cnt"))


@query(f"WITH {LOG_SQL} SELECT domain, count(*) AS pages_crawled, count(*) FILTER (status = 'blocked') AS pages_blocked, count(*) FILTER (status = 'skipped') AS pages_skipped FROM log GROUP BY domain")
def domain_counters(spark: SparkSession, d: str) -> DataFrame:
    return jobs.domain_counters(page_log(spark, d))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
