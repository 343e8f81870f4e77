"""Golden vectors of single expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievestone.functions import text as T
from sievestone.functions import urls as U
from sievestone.operators import classify, frontier, report


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://Example.com/News/?utm_source=x&b=2&a=1#frag", "https://example.com/news?a=1&b=2"), ("https://example.com", "https://example.com/"), ("https://example.com/a/?ref=z&q=", "https://example.com/a"),
    ("http://thther.example.com/de/83?page=2&ref=x", "http://thther.example.com/de/83?page=2"), ("https://e.com/x?b=a%20b&a=%7Ez", "https://e.com/x?a=~z&b=a+b"), ("not a url", "not a url"), ("", "/"),
])
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.lit(url))) == want


@pytest.mark.parametrize(("url", "want"), [("https://m.a.com/x", "mobile_url"), ("https://a.com/amp/x", "amp_url"), ("https://a.com/print/", "print_url"), ("https://a.com/x", None)])
def test_url_variant(spark, url, want):
    assert one(spark, U.url_variant(F.lit(url))) == want


@pytest.mark.parametrize(("url", "compat", "want"), [
    ("https://a.com/?q=x", True, None), ("https://a.com/?q=x", False, "search_result_url"), ("https://a.com/?a=1&q=x", True, "search_result_url"), ("https://a.com/list?page=31", False, "pagination_depth_too_high_31"), ("https://a.com/list?page=30", False, None),
    ("https://a.com/page/0099", False, "pagination_depth_too_high_99"), ("https://a.com/2024/05/", False, "calendar_or_archive_url"), ("https://a.com/x?sort=1&view=2", False, "trap_params_sort_view"), ("https://a.com/ajax/y", False, "infinite_scroll_or_ajax_endpoint"),
    ("https://a.com/a/b/c/d/e/f/g/h/i/j/k", False, "excessive_path_depth_11"), ("https://a.com/x?" + "&".join(f"w{i}=1" for i in range(9)), False, "too_many_query_params_9"), ("https://a.com/x?page=99999999999999999999", False, "pagination_depth_too_high_99999999999999999999"),
])
def test_trap(spark, url, compat, want):
    assert one(spark, U.trap_reason(F.lit(url), 0, compat)) == want


@pytest.mark.parametrize(("url", "compat", "want"), [
    ("https://www.bloomberg.com/x", False, (0.92, "financial_media", 2)), ("https://www.nasdaq.com/earnings/x", False, (0.98, "investor_relations", 1)), ("https://www.wsj.com/x", True, (0.30, "unknown", 5)), ("https://www.wsj.com/x", False, (0.90, "financial_media", 2)),
    ("https://finance.yahoo.com/q", False, (0.66, "financial_media", 3)), ("https://example.com/edgar/1", False, (1.0, "regulatory", 1)), ("", False, (0.30, "unknown", 5)),
])
def test_trust(spark, url, compat, want):
    assert tuple(one(spark, U.trust(F.lit(url), compat))) == want


def test_hashes(spark):
    assert one(spark, T.content_hash(F.lit("  Hello \n World "))) == "5eb63bbbe01eeed093cb22bb8f5acdc3"
    line = "The quick brown fox jumps over the lazy dog near the river bank "
    rows = spark.createDataFrame([(1, line + "today"), (2, line + "tonight"), (3, ""), (4, "é ü"), (5, None)], "k int, t string")
    got = {r["k"]: r["h"] for r in T.simhash(rows, "k", "t").select("k", T.simhash_hex(F.col("simhash")).alias("h")).collect()}
    assert got == {1: "2d00da003dc00a5a", 2: "3d20c8016dc40b5b", 3: "0" * 16, 4: "0" * 16, 5: "0" * 16}
    assert one(spark, T.hamming(F.lit(0x2D00DA003DC00A5A), F.lit(0x3D20C8016DC40B5B))) == 10


def test_jaccards(spark):
    words = lambda s: F.split(F.lit(s), " ")
    assert one(spark, T.jaccard(words("a b c"), words("a b c d"))) == 0.75
    assert one(spark, T.jaccard(T.char_ngrams(F.lit("Apple earnings")), T.char_ngrams(F.lit("Apple earnings beat")))) == 0.6875
    assert one(spark, T.jaccard(T.char_ngrams(F.lit("abc")), T.char_ngrams(F.lit("abcd")))) == 0.0


@pytest.mark.parametrize(("date", "decay", "step"), [("1998-12-01", 1.0, 1.0), ("1998-11-01", 0.5002, 0.9), ("1998-06-04", 0.0157, 0.7), ("1998-12-02", 1.0, 0.7), ("1995-12-02", None, 0.5), ("1995-11-30", None, 0.3), ("junk", 0.3, 0.3), ("", 0.3, 0.0), (None, 0.3, 0.0)])
def test_freshness(spark, date, decay, step):
    day, now = F.lit(date).cast("string"), F.lit("1998-12-01").cast("date")
    assert one(spark, T.freshness_step(day, now)) == step
    if decay is not None:
        assert one(spark, T.decay(day, now, 0.3)) == pytest.approx(decay, abs=5e-5)


def test_describe(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 10)] + [("b", 5.0), ("c", None)], "g string, v double")
    got = {r["g"]: r for r in report.describe(rows, "v", "g").collect()}
    assert [got["a"][c] for c in ("mean", "median", "std", "p25", "p75", "p90", "iqr")] == [4.0, 2.5, 4.0825, 1.75, 4.75, 7.9, 3.0]
    assert got["b"]["std"] == 0.0 and got["c"]["count"] == 0 and got["c"]["mean"] == 0.0


def test_scores(spark):
    assert round(one(spark, T.domain_score(F.lit(100), F.lit(55), F.lit(0.9), F.lit(30 / 130))), 4) == 0.7504
    assert round(one(spark, T.combined_score(F.lit(0.92), F.lit(0.85), F.lit(0.95), F.lit(1.0))), 4) == 0.913
    now = F.lit("1998-12-01").cast("date")
    text, none = F.lit("word " * 700), F.lit("")
    heads, no = F.array(F.lit("Head")), F.array().cast("array<string>")
    best = one(spark, classify.quality(F.lit("t"), F.lit("a"), F.lit("1998-12-01"), F.lit("en"), heads, F.lit(700), F.lit("clean"), no, F.lit("trafilatura"), text, now))
    assert (best["score"], best["grade"], best["reasons"]) == (1.0, "A", ["good_quality_article"])
    poor = one(spark, classify.quality(F.lit("t"), none, none, F.lit("en"), no, F.lit(200), F.lit("messy"), F.array(F.lit("x"), F.lit("y")), F.lit("bs4_heuristic"), text, now))
    assert (poor["score"], poor["grade"]) == (0.415, "D")


def test_sentiment_and_signals(spark):
    s = one(spark, T.sentiment(F.lit("shares rally and surge despite risk"), F.lit("")))
    assert s["label"] == "bullish" and round(s["score"], 3) == 0.333
    assert one(spark, T.signals(F.lit("The board approved a dividend and a merger"))) == ["capital_return", "corporate_action"]


def test_queries_expand():
    assert T.expand_query("AAPL")["ticker"] == "AAPL" and T.expand_query("AAPL")["company_name"] == "apple"
    assert T.expand_query("tesla stock")["ticker"] == "TSLA" and T.query_terms(T.expand_query("tesla stock")) == ["stock", "tesla", "tsla"]
    assert T.expanded_queries("fed") == ["fed", "federal reserve", "fed rate decision"]


@pytest.mark.parametrize(("status", "html", "server", "want"), [
    (429, "", "", ("rate_limited_429", True)), (503, "", "cloudflare", ("cloudflare_503", False)), (404, "", "", ("http_error_404", False)), (200, "x", "", ("suspiciously_empty_response", True)), (200, "<h1>are you human</h1>" + "x" * 300, None, ("captcha_detected", False)),
    (200, "<title>Just a moment</title>" + "x" * 5000, "", ("cloudflare_challenge", False)), (200, "x" * 300, "", ("", False)),
])
def test_blocks(spark, status, html, server, want):
    b = one(spark, T.block_status(F.lit(status), F.lit(html), F.lit(server).cast("string")))
    assert (b["reason"], b["should_retry"]) == want


def test_intervals(spark):
    assert one(spark, frontier.adapted(F.lit(86400.0), F.lit(True))) == 57600 and one(spark, frontier.adapted(F.lit(86400.0), F.lit(False))) == 129600
    assert one(spark, frontier.adapted(F.lit(4000.0), F.lit(True))) == 3600 and one(spark, frontier.adapted(F.lit(600000.0), F.lit(False))) == 604800
    assert one(spark, frontier.initial_interval(F.lit("hourly"), F.lit(""))) == 3600 and one(spark, frontier.initial_interval(F.lit(""), F.lit("wiki_page"))) == 604800


def test_summary_and_language(spark):
    assert one(spark, T.summary(F.lit("One. Two! " + "x" * 400 + "."))) == "One. Two!"
    assert one(spark, T.summary(F.lit("x" * 400 + ". Two."))) == ""
    assert one(spark, T.language(F.lit("der Hund und die Katze sind in dem Haus das ist gut"))) == "de"
    assert one(spark, T.language(F.lit("kurz"))) == "en"


def test_browser(spark):
    assert one(spark, T.js_framework(F.lit('<div id="root">'))) == "react" and one(spark, T.js_framework(F.lit("<p>"))) == ""
    assert one(spark, T.needs_browser(F.lit('<div id="root">'), F.lit(3))) and not one(spark, T.needs_browser(F.lit("<p>text</p>"), F.lit(3)))
