"""The ways to a page's main text, on pages where they differ."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievestone.functions import html as H
from sievestone.functions import maintext as M
from sievestone.plans.catalog import QUERIES

SENTENCE = "The council met on Monday to discuss the new budget, which had been delayed twice since spring. "
MENU = "<div><ul>" + "".join(f'<li><a href="/{i}">Section number {i} of this site</a></li>' for i in range(12)) + "</ul></div>"
FOOT = "<div><p>Terms of use</p><p>Contact</p></div>"


def found(html: str) -> tuple[str, str]:
    f = H.page_facts("http://e.com/a", html)
    return f["main_content"], f["extraction_method"]


def test_article_among_boilerplate():
    body = "".join(f"<p>{SENTENCE * n}<a href='/x'>source {n}</a></p>" for n in (1, 3, 2))
    teaser = "<div>" + "".join(f"<p><a href='/{i}'>{SENTENCE}</a></p>" for i in range(5)) + "</div>"
    text, way = found(f"<html><body>{MENU}<div><h1>Budget talks</h1>{body}<p>Short line.</p>{teaser}<p>{SENTENCE * 6}</p></div>{teaser}{FOOT}</body></html>")
    assert way == "density" and text.startswith("Budget talks The council") and "Short line." in text
    assert text.count("The council") == 12 and "source 3" in text
    assert "Section number" not in text and "Terms of use" not in text


def test_many_small_pieces():
    """Each line is too short for the density way, together they are the page."""
    lines = "".join(f"<p>Step {i}, turn {i} screws</p>" for i in range(40))
    text, way = found(f"<html><body>{MENU}<div>{lines}</div><div><p>About us</p></div></body></html>")
    assert way == "parents" and text.startswith("Step 0, turn 0 screws Step 1") and text.count("Step") == 40
    assert "Section number" not in text and "About us" not in text


def test_short_page():
    text, way = found("<html><body><div>Just a line.</div><section>Not much more here.</section></body></html>")
    assert (text, way) == ("Not much more here.", "heuristic")
    for empty in ("", "<html>", "<p></p>", "plain text", None):
        assert found(empty)[1] == "heuristic"


def test_noise_and_hidden():
    hidden = "".join(f"<div {how}><p>HIDDEN {SENTENCE * 3}</p></div>" for how in ('class="cookie-consent"', "hidden", 'aria-hidden="true"', 'style="display: none"', 'class="sidebar"'))
    text, way = found(f'<html><body class="has-sidebar"><aside><p>HIDDEN {SENTENCE * 3}</p></aside>{hidden}<div>{SENTENCE * 3}<br>More.</div><form><p>HIDDEN {SENTENCE * 3}</p></form></body></html>')
    assert way == "density" and "HIDDEN" not in text and text.endswith("More.")


def test_boundary_of_enough():
    for n, way in ((M.ENOUGH, "heuristic"), (M.ENOUGH + 2, "density")):
        text = ("a " * 60)[: n - 1] + "z" * (1 - n % 2 + 0)
        text = (text + "z" * n)[:n]
        assert found(f"<html><body><div><p>{text}</p></div></body></html>") == (text, way), n


def test_best_run():
    assert M.best_run([]) == (0, 0) and M.best_run([-1.0, -2.0]) == (0, 0)
    assert M.best_run([1.0, -3.0, 2.0, -1.0, 2.0, -9.0, 1.0]) == (2, 5)
    assert M.best_run([5.0, -5.0, 5.0]) == (0, 3)  # of equal sums the longest
    r = __import__("random").Random(1)
    for _ in range(300):
        x = [float(r.randrange(-4, 5)) for _ in range(r.randrange(1, 9))]
        best = max(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))
        first, end = M.best_run(x)
        assert sum(x[first:end]) == best
        assert end - first == (max(j - i for i in range(len(x)) for j in range(i, len(x) + 1) if sum(x[i:j]) == best) if best > 0 else 0)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + SENTENCE * 3, "<div>" + "<p>x, y" * 20_000, "<a>" * 20_000 + SENTENCE])
def test_deep_and_long_pages(page):
    text, _ = found(page)
    assert isinstance(text, str)


def test_one_parse_a_page(monkeypatch):
    parsed = []
    parse = H.parse
    monkeypatch.setattr(H, "parse", lambda html: parsed.append(html) or parse(html))
    H.page_facts("http://e.com/a", f"<body><div><p>{SENTENCE * 3}</p></div>")
    assert len(parsed) == 1


def test_query(spark):
    got = QUERIES["main_text"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    ways = {r[0]: r[1] for r in got.groupBy("extraction_method").agg(F.count("*")).collect()}
    assert ways["density"] > sum(ways.values()) / 2
