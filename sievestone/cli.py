"""Command line: python -m sievestone.cli COMMAND --help"""

from __future__ import annotations

import argparse
import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.html import host, page_markdown
from .functions.urls import trap_reason
from .operators import report
from .operators.classify import extract
from .operators.frontier import prioritized, reachable
from .plans import api, crawl
from .sources import feeds, http


def _shown(sections: dict[str, DataFrame]) -> None:
    for name, df in sections.items():
        print(f"\n== {name}")
        df.show(50, truncate=80)


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _log(df: DataFrame) -> DataFrame:
    """The page log with the columns that reports read."""
    return df.withColumns({"domain": F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), "is_content": F.coalesce("is_content", F.lit(0)), "is_duplicate": F.coalesce("is_duplicate", F.lit(0))})


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sievestone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, text, *args: [c := sub.add_parser(name, help=text), [c.add_argument(*a, **k) for a, k in args]]
    opt = lambda *a, **k: (a, k)
    add("crawl", "fetched pages (Parquet) or seed urls (text) to a page log", opt("--pages"), opt("--seeds"), opt("--out", required=True), opt("--delay", type=float, default=1.0))
    add("stats", "totals of a page log", opt("log"))
    add("analyze", "all report sections of a page log", opt("log"), opt("--json"))
    add("dashboard", "what a dashboard asks of a page log, as tables", opt("log"))
    add("inspect", "one page: trap, classification, article, Markdown", opt("url"), opt("--html"))
    add("discover", "urls of a sitemap table (file, xml), best first", opt("files"), opt("roots", nargs="+"))
    add("research", "articles of a page log for a query", opt("log"), opt("query"), opt("--min-trust", type=float, default=0.30), opt("--limit", type=int, default=20))
    add("demo", "reachable pages of a page table, two rounds", opt("pages"))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sievestone").getOrCreate()
    today = F.lit(date.today().isoformat()).cast("date")
    if a.command == "crawl":
        if a.pages:
            pages = _pages(spark, a.pages)
        else:
            got = http.crawl_round(feeds.seed_file(spark, a.seeds), delay=a.delay).filter("ok AND NOT is_pdf")
            pages = got.select(F.xxhash64("url").alias("page_id"), "url", "html")
        crawl.crawled(pages, today).write.mode("overwrite").parquet(a.out)
    elif a.command == "inspect":
        page = [(1, a.url, open(a.html, encoding="utf-8").read())] if a.html else [(1, a.url, http._get(a.url, http.AGENT, 15, 3)["html"])]
        row = extract(spark.createDataFrame(page, "page_id int, url string, html string"), today).withColumn("trap", trap_reason(F.col("url"))).first()
        print(json.dumps(row.asDict(recursive=True), indent=1, default=str, ensure_ascii=False), page_markdown(a.url, page[0][2]), sep="\n\n")
    elif a.command == "discover":
        found = feeds.sitemap_urls(_pages(spark, a.files), spark.createDataFrame([(r,) for r in a.roots], "file string"))
        prioritized(found.withColumn("ord", F.monotonically_increasing_id())).show(20, truncate=100)
    elif a.command == "demo":
        pages = _pages(spark, a.pages)
        reachable(pages.select("url").limit(20), crawl.outlinks(pages), 2, crawl.DEFAULTS["max_links"]).groupBy("depth").count().show()
    else:
        log = _log(_pages(spark, a.log))
        clean = log.filter(report.CLEAN)
        if a.command == "stats":
            _shown(api.stats(log))
        elif a.command == "dashboard":
            _shown({"domains": api.domains(log), **api.judging(log.withColumn("metadata_json", F.to_json(F.struct(F.col("reason"), F.col("reason").alias("duplicate_reason")))), clean)})
        elif a.command == "analyze":
            sections = report.full_report(log, clean)
            if a.json:
                feeds.json_report(sections).coalesce(1).write.mode("overwrite").text(a.json)
            _shown(sections)
        else:
            ranked = crawl.research(clean, a.query, today, a.min_trust)
            ranked.select("combined_score", "trust_label", "sentiment", "title", "url").show(a.limit, truncate=80)
    print(host(a.url) if a.command == "inspect" else "", end="")


if __name__ == "__main__":
    main()
