"""Pages over HTTP: a fetch as a DataFrame operation, one slow lane for each host."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import url_part
from ..operators.frontier import allowed
from .feeds import robots_rules

AGENT = "sievestone/1.0"
ACCEPTED = ("text/html", "application/xhtml", "application/pdf")
RESPONSE = "url string, final_url string, status_code int, html string, content_type string, error string, fetch_time_ms double, headers map<string,string>, is_pdf boolean, pdf_bytes binary"


def _get(url: str, agent: str, timeout: float, tries: int) -> dict:
    """One response; time-outs are tried again after 1, 2, 4 ... seconds, other errors are the row's result."""
    row = {"url": url, "final_url": url, "status_code": None, "html": "", "content_type": "", "error": "", "headers": {}, "is_pdf": False, "pdf_bytes": None}
    began = time.monotonic()
    for attempt in range(tries):
        try:
            try:
                r = urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout)
            except HTTPError as e:
                r = e
            with r:
                kind, body = (r.headers.get("Content-Type") or "").lower(), r.read()
            row |= {"final_url": r.geturl(), "status_code": r.status, "content_type": kind, "headers": {k.lower(): v for k, v in r.headers.items()}, "error": ""}
            if "application/pdf" in kind:
                row |= {"is_pdf": True, "pdf_bytes": body}
            elif r.status < 400 and not kind.startswith(ACCEPTED):
                row["error"] = f"non_html_content_type:{kind}"
            else:
                row["html"] = body.decode(r.headers.get_content_charset() or "utf-8", "replace")
            break
        except (TimeoutError, URLError, OSError, ValueError) as e:
            row["error"] = f"{type(e).__name__}: {e}"[:300]
            if not isinstance(getattr(e, "reason", e), TimeoutError) or attempt == tries - 1:
                break
            time.sleep(2**attempt)
    return row | {"fetch_time_ms": (time.monotonic() - began) * 1000}


def fetch(urls: DataFrame, url: str = "url", delay: float = 1.0, timeout: float = 15.0, tries: int = 3, agent: str = AGENT) -> DataFrame:
    """A response row for each distinct url, with block detection: blocked, blocked_reason, should_retry, ok.

    Urls are dealt by host, so a host's pages are fetched one after another, `delay` seconds apart, by one task; more hosts
    are more lanes.  Responses come out as they arrive: nothing is held but one page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for b in batches:
            for host, u in zip(b["host"], b["url"], strict=True):
                if (wait := last.get(host, float("-inf")) + delay - time.monotonic()) > 0:
                    time.sleep(wait)
                row = _get(u, agent, timeout, tries)
                last[host] = time.monotonic()
                yield pd.DataFrame([row])[[c.split()[0] for c in RESPONSE.split(", ")]]

    dealt = urls.select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct().withColumn("host", url_part(F.col("url"), "host")).repartition("host")
    rows = dealt.mapInPandas(run, RESPONSE)
    b = T.block_status(F.coalesce("status_code", F.lit(0)), F.col("html"), F.try_element_at("headers", F.lit("server")))
    refused = F.col("error").startswith("non_html")
    judged = rows.withColumns({"blocked": F.when(refused, True).when(F.col("is_pdf") | (F.col("error") != ""), False).otherwise(b.blocked), "blocked_reason": F.when(refused, F.col("error")).when(F.col("is_pdf") | (F.col("error") != ""), "").otherwise(b.reason), "should_retry": F.when(F.col("error") == "", b.should_retry).otherwise(False)})
    return judged.withColumn("ok", (F.col("error") == "") & ~F.col("blocked"))


def robots(urls: DataFrame, url: str = "url", agent: str = AGENT, **how: float) -> DataFrame:
    """(host, prefixes, sitemaps) of the hosts of urls; a file that can't be had forbids nothing."""
    roots = urls.select(F.concat(url_part(F.col(url), "scheme"), F.lit("://"), url_part(F.col(url), "host"), F.lit("/robots.txt")).alias("url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [_raw(u, agent) for u in b["url"]]
            yield pd.DataFrame({"host": b["host"], "body": got})

    files = roots.distinct().withColumn("host", url_part(F.col("url"), "host")).dropDuplicates(["host"]).mapInPandas(run, "host string, body string")
    return robots_rules(files, agent)


def _raw(url: str, agent: str) -> str:
    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=10) as r:
            return r.read().decode("utf-8", "replace") if r.status == 200 else ""
    except (OSError, ValueError):
        return ""


def crawl_round(urls: DataFrame, **how: float) -> DataFrame:
    """Responses of the urls that their hosts' robots files allow."""
    return fetch(allowed(urls, robots(urls)), **how)
