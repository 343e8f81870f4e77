"""HTML, feeds, dedup order, frontier and streams on small rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sievestone.functions import html as H
from sievestone.operators import classify, dedup, frontier, ranking
from sievestone.plans import crawl
from sievestone.sources import feeds
from sievestone.streaming import jobs

PAGE = """<html><head><title>Tax Guide | Site</title><meta name="author" content="Ann B"><link rel="canonical" href="/c"><script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "2024-01-02T03"}</script></head>
<body><nav><a href="/n">n</a></nav><article><h1>Hello World</h1><p>Some <b>bold</b> <a href="/l?a=1#z">link</a><br>more<p>open<ul><li>one<li>two</ul><table><tr><th>a<th>b<tr><td>1|2</table>
<pre><code class="language-py">x=1</code></pre><img src="/i.png" alt="A"></article><script>var t="</p>";</script></body></html>"""


def test_facts():
    f = H.page_facts("http://e.com/a", PAGE)
    assert (f["canonical_url"], f["title"], f["author"], f["published_date"]) == ("http://e.com/c", "Hello World", "Ann B", "2024-01-02")
    assert f["schema_types"] == ["NewsArticle"] and f["html_quality"] == "clean" and "Some bold link" in f["main_content"] and f["n_links"] == 1
    empty = H.page_facts(None, None)
    assert empty["main_content"] == "" and "no_body_tag" in empty["problems_detected"]


def test_places_of_a_field():
    def facts(*parts):
        return H.page_facts("http://e.com/a", "".join(parts))

    linked, meta, line = '<script type="application/ld+json">[1, {"author": [{"name": " L  M "}], "dateCreated": "2020-02-03T00"}]</script>', '<meta name="byl" content="By Q"><meta name="date" content="2021-01-01 09:00">', '<p class="Post-Author big">Bob</p><time datetime="2022-05-06T1">x</time>'
    for parts, author, date in [((line, meta, linked), "L M", "2020-02-03"), ((line, meta), "By Q", "2021-01-01"), ((line,), "Bob", "2022-05-06"), ((), "", "")]:
        got = facts(*parts)
        assert (got["author"], got["published_date"]) == (author, date) and ("missing_author" in got["problems_detected"]) == (not author)
    assert [facts(h)["title"] for h in ('<h1>b</h1><meta property="og:title" content="a  c">', "<title>T – S</title><h1>b</h1>", "<title>T – S</title>", "")] == ["a c", "b", "T", ""]
    assert facts('<script type="application/ld+json">{bad</script>')["schema_types"] == []
    images = facts('<img src="http://[bad"><img src="/p.png" width="1"><img><img src="/²" width="²">', '<img src="/i">' * 20)["images"]
    assert [i["src"] for i in images] == ["http://e.com/²"] + ["http://e.com/i"] * 9


def test_markdown_and_links():
    md = H.page_markdown("http://e.com/a", PAGE)
    for part in ("# Hello World", "Some **bold** [link](http://e.com/l?a=1#z) more", "- one\n- two", "| 1\\|2 |  |", "```py\nx=1\n```", "![A](http://e.com/i.png)"):
        assert part in md
    assert H.page_links("http://e.com/a", PAGE + '<a href="mailto:x">m</a><a href="http://[bad">b</a>') == ["http://e.com/n", "http://e.com/l?a=1"]
    assert H.page_markdown("", "") == "" and H.pdf_facts("")["problems_detected"] == ["pdf_text_extraction_failed"]
    assert H.pdf_facts("ANNUAL REPORT\nSection 1 x\nbody")["headings"] == ["ANNUAL REPORT", "Section 1 x"]


def test_classification(spark):
    rows = spark.createDataFrame([(1, "https://e.com/news/2024/01/02/a-b-c-d-e", PAGE), (2, "https://e.com/", ""), (3, "https://e.com/login", None)], "k int, url string, html string")
    got = {r["k"]: r["c"] for r in rows.select("k", classify.classification(F.col("url"), H.facts("url", "html")).alias("c")).collect()}
    assert got[1]["is_content_page"] and got[1]["page_type"] == "educational" and "article_slug_url" in got[1]["signals"]
    assert not got[2]["is_content_page"] and not got[3]["is_content_page"]


def test_layers_in_order(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "https://a.com/1", "https://a.com/1", text, "A long enough title here"), (2, "https://a.com/1/?utm_source=x", "https://a.com/1", "other words than before " * 4, "Another title of some kind"), (3, "https://m.a.com/9", "https://a.com/9", "mobile", ""),
            (4, "https://a.com/4", "https://a.com/4", "quite different body text with words that share nothing at all", "a LONG enough title here!"), (5, "https://a.com/5", "https://a.com/5", text.upper(), "Completely unrelated headline words"), (6, "https://a.com/6", "https://a.com/6", "tiny", "")]
    got = {r["ord"]: r["reason"] for r in dedup.layered(spark.createDataFrame(rows, "ord int, url string, canonical_url string, main_content string, title string")).collect()}
    assert got == {2: "normalized_url_match", 3: "mobile_url", 4: "title_similarity_1.00", 5: "exact_content_hash"}


def test_rejected_rows_shadow_nothing(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "https://a.com/1", "https://a.com/1", text, "", False), (2, "https://a.com/2", "https://a.com/2", text, "", True), (3, "https://a.com/3", "https://a.com/3", text, "", True)]
    df = spark.createDataFrame(rows, "ord int, url string, canonical_url string, main_content string, title string, ok boolean")
    assert {r["ord"] for r in dedup.layered(df, passes=F.col("ok")).collect()} == {3}


def test_leaders(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    got = {r["k"]: r["leader"] for r in ranking.leader_clusters(spark.range(1, 6).select(F.col("id").cast("int").alias("k")), pairs, "k").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_sitemaps_and_feeds(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    files = [("r", f"<sitemapindex {ns}><sitemap><loc>s1</loc></sitemap></sitemapindex>"), ("s1", f"<urlset {ns}><url><loc>https://a.com/1</loc><priority>0.5</priority><changefreq>daily</changefreq><lastmod>2024-01-01T00</lastmod></url></urlset>"), ("x", "<urlset><url><loc>https://b.com/2</loc>")]
    df = spark.createDataFrame(files, "file string, xml string")
    got = feeds.sitemap_urls(df, spark.createDataFrame([("r",), ("x",)], "file string")).collect()
    assert [(r["url"], r["lastmod"]) for r in got] == [("https://a.com/1", "2024-01-01"), ("https://b.com/2", "")]
    rss = "<rss><channel><item><title>Rate news</title><link>https://a.com/r</link><description>&lt;b&gt;x&lt;/b&gt;</description></item><item><title>Other</title><link>https://a.com/o</link></item></channel></rss>"
    rows = feeds.feed_rows(spark.createDataFrame([("f", rss), ("g", "broken <")], "source string, xml string"), ["rate"]).collect()
    assert [(r["url"], r["snippet"]) for r in rows] == [("https://a.com/r", "x")]
    found = feeds.discover([feeds.generated(spark, "bond yields"), feeds.seeds(spark, "bond").select("url", F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit("seed").alias("source"))], 50)
    assert found.filter("url = 'https://www.investopedia.com/terms/b/bond.asp'").first()["source"] == "domain_targeted"
    page = '<a href="/l?uddg=https%3A%2F%2Fa.com%2Fx">A long result title</a><a href="https://b.com">no</a>'
    assert [r["url"] for r in feeds.result_links(spark.createDataFrame([(page,)], "html string"), "ddg", unwrap="uddg").collect()] == ["https://a.com/x"]
    wiki = '{"query": {"search": [{"title": "Interest rate", "snippet": "<span>a</span> b"}]}}'
    assert feeds.wikipedia_rows(spark.createDataFrame([(wiki,)], "json string")).first()["url"].endswith("/Interest_rate")


def test_robots_and_reach(spark):
    rules = feeds.robots_rules(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /p\nUser-agent: other\nDisallow: /q\nSitemap: https://a.com/s.xml")], "host string, body string"))
    assert rules.first()["sitemaps"] == ["https://a.com/s.xml"]
    urls = spark.createDataFrame([("https://a.com/p/1",), ("https://a.com/q/1",), ("https://b.com/p",)], "url string")
    assert {r["url"] for r in frontier.allowed(urls, rules).collect()} == {"https://a.com/q/1", "https://b.com/p"}
    links = spark.createDataFrame([("s", "https://a.com/x", 0), ("https://a.com/x", "https://a.com/y", 0), ("https://a.com/y", "s", 0), ("https://a.com/x", "https://a.com/ajax/1", 1)], "src string, dst string, ord int")
    got = {(r["url"], r["depth"]) for r in frontier.reachable(spark.createDataFrame([("s",)], "url string"), links, 5).collect()}
    assert got == {("s", 0), ("https://a.com/x", 1), ("https://a.com/y", 2)}


def test_articles_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.com", "T", 3)], "url string, title string, word_count int")
    feeds.write_articles(rows, str(tmp_path / "a"))
    (tmp_path / "a" / "bad.json").write_text("{broken\n\n")
    assert feeds.articles(spark, str(tmp_path / "a")).select("url", "word_count").collect() == [("https://a.com", 3)]


def test_outlinks(spark):
    pages = spark.createDataFrame([("https://www.a.com/1", '<a href="/2">x</a><a href="https://b.com/">y</a><a href="/f.zip">z</a>')], "url string, html string")
    assert [r["dst"] for r in crawl.outlinks(pages).collect()] == ["https://www.a.com/2"]
    assert {r["dst"] for r in crawl.outlinks(pages, domains=["b.com"]).collect()} == {"https://www.a.com/2", "https://b.com/"}


def test_streams(spark, tmp_path):
    rows = [("u1", float(t), h, datetime(2024, 1, 1 + t)) for t, h in enumerate(("a", "a", "b"))]
    df = spark.createDataFrame(rows, "url string, t double, digest string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = jobs.drained(jobs.recrawl(stream.select("url", "t", "digest")), str(tmp_path / "o1"), str(tmp_path / "c1"), "update").first()
    fold = frontier.recrawl_fold(df, "url", "ts", "digest").first()
    assert (got["interval"], got["times_changed"], got["times_unchanged"]) == (fold["interval"], 1, 1) == (86400.0, 1, 1)
    days = jobs.drained(jobs.daily_counts(stream, "ts", "digest"), str(tmp_path / "o2"), str(tmp_path / "c2"), "update")
    assert days.groupBy("day", "digest").agg(F.max_by("cnt", "batch")).count() == 3
