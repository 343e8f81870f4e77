"""Fetching from a local server, dashboard functions and the command line."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sievestone import cli
from sievestone.plans import api
from sievestone.sources import http

BODY = "<html><body><article><h1>A title of a page that is long</h1><p>" + "word and more words. " * 200 + "</p></article></body></html>"


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        kind, status, body = {"/robots.txt": ("text/plain", 200, "User-agent: *\nDisallow: /no"), "/news/a": ("text/html", 200, BODY), "/pdf": ("application/pdf", 200, "%PDF"), "/img": ("image/png", 200, "x"), "/gone": ("text/html", 404, "no")}.get(self.path, ("text/html", 429, ""))
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site):
    urls = spark.createDataFrame([(site + p,) for p in ("/news/a", "/pdf", "/img", "/gone", "/slow", "/no/x", "/news/a")] + [("http://127.0.0.1:1/x",), (None,)], "url string")
    rows = {r["url"].rsplit(":", 1)[1].split("/", 1)[1]: r for r in http.crawl_round(urls, delay=0.0).collect()}
    assert set(rows) == {"news/a", "pdf", "img", "gone", "slow", "x"}
    assert rows["news/a"]["ok"] and rows["news/a"]["html"] == BODY and rows["pdf"]["pdf_bytes"] == b"%PDF" and rows["pdf"]["ok"]
    assert rows["img"]["blocked_reason"] == "non_html_content_type:image/png" and rows["gone"]["blocked_reason"] == "http_error_404"
    assert rows["slow"]["should_retry"] and not rows["x"]["ok"] and rows["x"]["error"]


def test_dashboard(spark):
    rows = [("u1", "d", "blocked", 0, 0, None, '{"metadata_json": "{\\"blocked_reason\\": \\"x\\"}"}', 0.1, 1.0), ("u2", "d", "fetched", 1, 1, "a", '{"duplicate_reason": "canonical_url_match"}', 0.9, 2.0), ("u3", "e", "fetched", 1, 0, "a", None, 0.9, 3.0)]
    pages = spark.createDataFrame(rows, "url string, domain string, status string, is_content int, is_duplicate int, page_type string, metadata_json string, quality_score double, crawled_at double")
    docs = pages.select("url", "quality_score", F.lit("heuristic").alias("extraction_method"), F.lit("clean").alias("html_quality"), F.array(F.lit("p")).alias("problems_detected"), F.col("page_type").alias("title"))
    j = api.judging(pages, docs)
    assert j["blocked_reasons"].collect() == [("x", 1)] and j["duplicates"].collect() == [("Canonical URL", 1)] and j["fields"].collect() == [("title", 2, 66.7)]
    assert [r["url"] for r in api.articles(pages).collect()] == ["u3"] and api.domains(pages).first()["pages_crawled"] == 2
    assert api.stats(pages)["totals"].first()["clean_articles"] == 1
    s = spark.createDataFrame([(1.0, 3600.0, 2), (9.0, 7200.0, 0)], "next_crawl double, interval double, times_changed long")
    assert tuple(api.recrawl_stats(s, F.lit(5.0)).first()) == (2, 1, 1.5, 2)


def test_command_line(spark, tmp_path, capsys):
    pages = [(i, f"https://e.com/news/story-number-{i}-of-many", BODY.replace("title", f"title{i}").replace("word and", f"word{i} tax{i * 7}")) for i in range(3)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    cli.main(["crawl", "--pages", str(tmp_path / "p"), "--out", str(tmp_path / "log")])
    cli.main(["stats", str(tmp_path / "log")])
    cli.main(["analyze", str(tmp_path / "log"), "--json", str(tmp_path / "j")])
    cli.main(["research", str(tmp_path / "log"), "words and word1"])
    (tmp_path / "x.html").write_text(BODY)
    cli.main(["inspect", "https://e.com/news/a", "--html", str(tmp_path / "x.html")])
    out = capsys.readouterr().out
    assert "clean_articles" in out and "title1" in out and "# A title" in out and '"crawl_health"' in "".join(f.read_text() for f in (tmp_path / "j").glob("part*"))
