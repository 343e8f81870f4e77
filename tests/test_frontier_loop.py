"""The crawl loop on a local site: to a fixed point, within limits, politely, and over a restart."""

from __future__ import annotations

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sievestone.streaming.frontier_loop import FETCH, ORDER, Loop

#: A cycle, a page that is linked under several spellings, a chain that goes deep, a forbidden page and a dead link.
LINKS = {"/": ["/a", "/b", "/no/x", "/gone", "mailto:x@y"], "/a": ["/b", "/", "/b?utm_source=z", "/b#part"], "/b": ["/c1"], "/c1": ["/c2"], "/c2": ["/c3"], "/c3": ["/c4", "/?q=x&page=2&p=3"], "/c4": ["/c5"], "/c5": ["/"], "/more": ["/a", "/late"], "/late": []}


@pytest.fixture
def site():
    hits: list[tuple[str, float]] = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append((self.path, time.monotonic()))
            known = self.path in LINKS
            body = "User-agent: *\nDisallow: /no" if self.path == "/robots.txt" else "<html><body>" + "".join(f'<a href="{x}">x</a>' for x in LINKS.get(self.path, [])) + "</body></html>"
            self.send_response(200 if known or self.path == "/robots.txt" else 404)
            self.send_header("Content-Type", "text/plain" if self.path == "/robots.txt" else "text/html")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", hits
    server.shutdown()


def test_crawl_to_a_fixed_point_and_over_a_restart(spark, tmp_path, site):
    root, hits = site
    loop = Loop(spark, str(tmp_path / "crawl"), delay=0.3, max_depth=5)
    loop.add(spark.createDataFrame([(root + "/",), (root + "/",), (None,), ("no url",)], "url string"))
    part = loop.run(every="200 milliseconds", max_seconds=60, max_total=3)
    assert 3 <= part < 10 and loop.queued > loop.fetched
    again = Loop(spark, str(tmp_path / "crawl"), delay=0.3, max_depth=5)
    again.add(spark.createDataFrame([(root + "/a", 0), (root + "/more", 2)], "url string, priority int"))
    assert again.run(every="200 milliseconds", max_seconds=60) > part
    paths = Counter(p for p, _ in hits)
    want = {"/", "/a", "/b", "/c1", "/c2", "/c3", "/c4", "/gone", "/more", "/late"}
    assert set(paths) - {"/robots.txt"} == want, "what is allowed within the depth, and nothing else"
    assert set(paths.values()) == {1}, "nothing twice, the robots file included"
    times = sorted(t for p, t in hits if p != "/robots.txt")
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.2
    pages = {r["url"].removeprefix(root): r for r in again.pages().collect()}
    assert set(pages) == want and pages["/c4"]["depth"] == 5 and pages["/gone"]["status_code"] == 404
    given = again._table("orders", ORDER)
    assert given.filter(f"kind = '{FETCH}'").count() == given.filter(f"kind = '{FETCH}'").select("url").distinct().count() == 11
    last = Loop(spark, str(tmp_path / "crawl"), delay=0.3, max_depth=5)
    assert last.run(every="200 milliseconds", max_seconds=60) == 11 and len(hits) == len(want) + 1


def test_a_batch_that_runs_again_fetches_nothing(spark, tmp_path):
    asked = []

    def fetch(urls):
        asked.append(sorted(r[0] for r in urls.collect()))
        rows = [(u, u, 200, '<a href="/next">n</a>', "text/html", "", 1.0, {}, False, None) for u in asked[-1]]
        from sievestone.sources import http

        return spark.createDataFrame(rows, http.RESPONSE)

    loop = Loop(spark, str(tmp_path / "crawl"), fetch=fetch, robots=lambda urls: spark.createDataFrame([], "host string, prefixes array<string>"))
    rows = spark.createDataFrame([("h", "http://h/x", 0, FETCH), ("h", "http://h/y", 0, "queued")], ORDER)
    for _ in range(2):
        loop.batch(rows, 4)
    assert asked == [["http://h/x"]] and loop.pages().count() == 1
    assert [tuple(r) for r in spark.read.parquet(loop._path("frontier", 4)).collect()] == [("http://h/next", 1, 0)]


def test_limits_and_priorities(spark, tmp_path):
    """Two hosts side by side: high priorities first, max_pages for each."""
    order = []

    def fetch(urls):
        from sievestone.sources import http

        got = sorted(r[0] for r in urls.collect())
        order.extend(got)
        return spark.createDataFrame([(u, u, 200, "", "text/html", "", 1.0, {}, False, None) for u in got], http.RESPONSE)

    loop = Loop(spark, str(tmp_path / "crawl"), delay=0.0, max_pages=4, fetch=fetch, robots=lambda urls: spark.createDataFrame([], "host string, prefixes array<string>"))
    loop.add(spark.createDataFrame([(f"http://{h}/{p}{i}", p) for h in ("a", "b") for p in (0, 2, 1) for i in range(2)], "url string, priority int"))
    assert loop.run(every="100 milliseconds", max_seconds=60) == 8
    for h in "ab":
        assert [u.rsplit("/", 1)[1] for u in order if f"//{h}/" in u] == ["20", "21", "10", "11"]
