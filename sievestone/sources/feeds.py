"""Sources of urls and pages: robots files, sitemaps, feeds, search results, seeds, stored articles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.html import parse
from ..functions.urls import trust
from ..operators.frontier import first_wins

ARTICLE = ("url string, canonical_url string, status string, page_type string, is_content int, title string, author string, published_date string, language string, main_content string, summary string, quality_score double, content_hash string, simhash string, is_duplicate int, "
           "word_count int, headings array<string>, images array<struct<src:string,alt:string,caption:string>>, source_domain string, html_quality string, problems_detected array<string>, extraction_method string, quality_grade string, quality_reasons array<string>, "
           "quality_breakdown struct<completeness:double,content_length:double,cleanliness:double,freshness:double,extraction_confidence:double>, page_classification struct<page_type:string,is_content_page:boolean,confidence:double,signals:array<string>>")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Stored articles from JSON lines; lines that can't be read are passed over.  The schema is given: no inference pass."""
    return spark.read.schema(ARTICLE).option("mode", "DROPMALFORMED").json(path)


def write_articles(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_markdown(df: DataFrame, path: str) -> None:
    df.select("url", "title", "markdown", "word_count", "quality_score").write.mode("append").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.select("ts", "level", "message").write.mode("append").parquet(path)


def json_report(sections: dict[str, DataFrame]) -> DataFrame:
    """One row with the report as JSON: each section a list of objects (sections are reports, a few rows each)."""
    spark = next(iter(sections.values())).sparkSession
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for name, df in sections.items():
        rows = df.agg(F.collect_list(F.struct(*[F.col(c) for c in df.columns])).alias(name))
        out = out.crossJoin(F.broadcast(rows))
    return out.select(F.to_json(F.struct(*sections)).alias("report"))


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, prefixes, sitemaps) of robots files (host, body): Disallow lines under * or the agent, Sitemap lines anywhere."""

    def read(body: pd.Series) -> pd.DataFrame:
        out = []
        for text in body:
            active, prefixes, maps = False, [], []
            for line in (text or "").splitlines():
                name, _, value = line.partition(":")
                name, value = name.strip().lower(), value.strip()
                if name == "user-agent":
                    active = value.lower() in ("*", agent.lower())
                elif name == "disallow" and active and value:
                    prefixes.append(value)
                elif name == "sitemap":
                    maps.append(value)
            out.append({"prefixes": prefixes, "sitemaps": maps})
        return pd.DataFrame(out, columns=["prefixes", "sitemaps"])

    texts = T.ArrayType(T.StringType())
    parsed = F.pandas_udf(read, T.StructType([T.StructField("prefixes", texts), T.StructField("sitemaps", texts)]))
    return robots.select("host", parsed("body").alias("r")).select("host", "r.prefixes", "r.sitemaps")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_sitemap(xml: str) -> list[dict]:
    """Rows of one sitemap file: kind 'index' for a further sitemap, 'url' for a page.  Broken XML gives its <loc>s."""
    try:
        root = ElementTree.fromstring(xml.encode())
    except (ElementTree.ParseError, ValueError):
        return [{"kind": "url", "loc": u, "ord": k, "lastmod": "", "changefreq": "", "priority": 0.5, "is_news": False} for k, u in enumerate(re.findall(r"<loc>\s*(.*?)\s*</loc>", xml))]
    rows = []
    for k, node in enumerate(root):
        found = {_local(c.tag): (c.text or "").strip() for c in node}
        if not found.get("loc"):
            continue
        try:
            priority = float(found.get("priority") or 0.5)
        except ValueError:
            priority = 0.5
        rows.append({"kind": "index" if _local(root.tag) == "sitemapindex" else "url", "loc": found["loc"], "ord": k, "lastmod": found.get("lastmod", "")[:10], "changefreq": found.get("changefreq", ""), "priority": priority, "is_news": "news" in found})
    return rows


SITEMAP_ROW = "kind string, loc string, ord int, lastmod string, changefreq string, priority double, is_news boolean"


def sitemap_rows(files: DataFrame) -> DataFrame:
    """files (file, xml) exploded to their rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"file": f} | r for f, x in zip(b["file"], b["xml"], strict=True) for r in read_sitemap(x or "")], columns=["file", *[c.split()[0] for c in SITEMAP_ROW.split(", ")]])

    return files.select("file", "xml").mapInPandas(read, f"file string, {SITEMAP_ROW}")


def sitemap_urls(files: DataFrame, roots: DataFrame, most: int = 5000) -> DataFrame:
    """Page rows reachable from root files through indexes of SITEMAP_DEPTH levels, each url once, at most `most`."""
    rows = sitemap_rows(files).cache()
    reached = now = roots.select("file").distinct()
    for _ in range(C.SITEMAP_DEPTH):
        now = rows.filter("kind = 'index'").join(now, "file", "left_semi").select(F.col("loc").alias("file")).distinct().join(reached, "file", "left_anti")
        reached = reached.unionByName(now)
    pages = rows.filter("kind = 'url'").join(reached.distinct(), "file", "left_semi").withColumnRenamed("loc", "url")
    return first_wins(pages.withColumn("_o", F.struct("file", "ord")), "url", "_o").drop("_o").orderBy("file", "ord").limit(most)


def feed_rows(feeds: DataFrame, terms: list[str], most: int = 30) -> DataFrame:
    """(url, title, snippet, source) of RSS and Atom files (source, xml) whose title or snippet holds a term; one source passes whole."""

    def items(xml: str) -> list[dict]:
        try:
            root = ElementTree.fromstring(xml.encode())
        except (ElementTree.ParseError, ValueError):
            return []
        out = []
        for node in [n for n in root.iter() if _local(n.tag) in ("item", "entry")][:most]:
            found: dict = {}
            for c in node:
                found.setdefault(_local(c.tag), c)
            link, body = found.get("link"), next((found[k] for k in ("description", "summary", "content") if k in found), None)
            url = (link.get("href") or link.text or "").strip() if link is not None else ""
            if found.get("title") is not None and url.startswith("http"):
                out.append({"url": url, "title": (found["title"].text or "").strip(), "snippet": parse("".join(body.itertext()) if body is not None else "").text()[:300]})
        return out

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r | {"source": s} for s, x in zip(b["source"], b["xml"], strict=True) for r in items(x or "")], columns=["url", "title", "snippet", "source"])

    rows = feeds.select("source", "xml").mapInPandas(read, "url string, title string, snippet string, source string")
    text = F.lower(F.concat("title", F.lit(" "), "snippet"))
    return rows.filter((F.col("source") == C.ALWAYS_ON_FEED) | F.exists(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: text.contains(t)))


def wikipedia_rows(answers: DataFrame) -> DataFrame:
    """Search answers (json) to rows: titles to article urls, snippets without tags."""
    found = answers.select(F.explode(F.from_json("json", "query struct<search:array<struct<title:string,snippet:string>>>").query.search).alias("r"))
    return found.select(F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.col("r.title"), F.lit(" "), F.lit("_"))).alias("url"), F.col("r.title").alias("title"), F.substring(F.regexp_replace("r.snippet", "<[^>]+>", ""), 1, 300).alias("snippet"), F.lit("wikipedia").alias("source"))


def result_links(pages: DataFrame, source: str, keep: str = "^https?://", unwrap: str | None = None, least: int = 10) -> DataFrame:
    """Links of search-result pages (html): those whose target matches `keep` and whose text is long enough; `unwrap` names
    the query parameter in which an engine hides a target."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"href": a.attrs.get("href", ""), "title": a.text()} for x in b["html"] for a in parse(x or "").find_all("a")], columns=["href", "title"])

    rows = pages.select("html").mapInPandas(read, "href string, title string")
    hidden = F.try_url_decode(F.regexp_extract("href", rf"[?&]{unwrap}=([^&#]*)", 1)) if unwrap else F.lit("")
    rows = rows.withColumn("url", F.when(hidden != "", hidden).otherwise(F.col("href")))
    return rows.filter(F.col("url").rlike(keep) & (F.length("title") >= least)).dropDuplicates(["url"]).select("url", "title", F.lit("").alias("snippet"), F.lit(source).alias("source"))


def generated(spark: SparkSession, query: str) -> DataFrame:
    """Glossary pages that the first words of a query may have."""
    words = [w for w in re.findall("[a-z]+", query.lower()) if len(w) >= 3][:5]
    return spark.createDataFrame([(f"https://www.investopedia.com/terms/{w[0]}/{w}.asp", f"{w} (Investopedia term)", "", "domain_targeted") for w in words], "url string, title string, snippet string, source string")


def seeds(spark: SparkSession, query: str) -> DataFrame:
    """(url, priority): pages to start a query from, by keyword; the first mention of a url counts."""
    low = query.lower()
    rows = [(k, u, p) for k, (u, p) in enumerate(x for words, urls in C.SEEDS if not words or any(w in low for w in words) for x in urls)]
    return first_wins(spark.createDataFrame(rows, "ord int, url string, priority double"), "url", "ord").orderBy(F.desc("priority"), "ord").select("url", "priority")


def discover(sources: list[DataFrame], most: int) -> DataFrame:
    """Rows of all sources in their order; the first source of a url wins, the most trusted come first."""
    out = None
    for k, s in enumerate(sources):
        part = s.select("url", "title", "snippet", "source").withColumn("ord", F.monotonically_increasing_id() + F.lit(k << 40))
        out = part if out is None else out.unionByName(part)
    t = trust(F.col("url"))
    return first_wins(out, "url", "ord").withColumns({"trust_score": t.score, "trust_tier": t.tier}).orderBy(F.desc("trust_score"), "ord").limit(most).drop("ord")


def terms_of(query: str) -> list[str]:
    """Search terms of a query: words of three letters or digits, without a few common ones."""
    return sorted(set(re.findall("[a-z0-9]{3,}", query.lower())) - set(C.QUERY_NOISE))


