"""The ranking against one query, and n-grams of long texts."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievestone.functions import constants as C
from sievestone.functions import text as T
from sievestone.operators import ranking

LONG = "the quick brown fox of the nation " * 300
DOCS = [
    (1, "A nation on the hand", "The nation has a hand; another nation too"), (2, "", ""), (3, None, None), (4, "wörter 😀😀😀 ωμέγα", "x😀yz 😀\t\n hand"), (5, LONG, LONG), (6, "and of", "abc"),
    (7, "nation", "one row of a key"), (7, "hand", "another row of this key, with the nation"), (None, "nation", "no key"), (8, "elsewhere words", "nothing of it"),
]
ASKED = "the nation on the other hand never"


def plain(docs, query):
    """{key: [(cosine, jaccard, title_match)]}"""
    tokens = lambda t: [w for w in re.findall(r"\w{3,}", t.lower()) if w not in C.RANKING_STOP_WORDS]
    bodies = [b or "" for _, _, b in docs] + [query]
    df = Counter(w for b in bodies for w in set(tokens(b)))

    def vector(text):
        v = {w: n * (math.log((len(bodies) + 1) / (df[w] + 1)) + 1 if w in df else math.log(100)) for w, n in Counter(tokens(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def grams(t):
        low = re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower())
        return {low[i : i + 4] for i in range(len(low) - 3)}

    q, g = vector(query), grams(query)
    share = lambda t: len(g & grams(t)) / len(g | grams(t)) if g and grams(t) else 0.0
    merged, out = {}, {}
    for k, t, b in docs:
        merged[k] = merged.get(k, "") + " " + ((t or "") + " ") * 3 + (b or "")[:5000]
    for k, t, b in docs:
        v = vector(merged[k]) if k is not None else {}
        out.setdefault(k, []).append(tuple(round(x, 6) for x in (sum(w * v.get(x, 0) for x, w in q.items()), share((b or "")[:1000]), share(t or ""))))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rank(spark, monkeypatch, kind):
    made, vectors = [], ranking.vectors
    monkeypatch.setattr(ranking, "vectors", lambda docs, *rest: made.append(docs.count()) or vectors(docs, *rest))
    docs = [(k if k is None or kind == "long" else f"k{k}", t, b) for k, t, b in DOCS]
    got = {}
    for r in ranking.rank(spark.createDataFrame(docs, f"k {kind}, t string, b string").repartition(3), ASKED, "k", "t", "b").collect():
        assert r["combined"] == pytest.approx(min(r["cosine"] * 0.5 + r["jaccard"] * 0.2 + r["title_match"] * 0.3, 1))
        got.setdefault(r["k"], []).append(tuple(round(r[c], 6) for c in ("cosine", "jaccard", "title_match")))
    assert {k: sorted(v) for k, v in got.items()} == plain(docs, ASKED)
    if kind == "long":
        assert sorted(made) == [1, 2]  # in long form are the query and the rows of one key only


def test_grams_are_not_counted_from_the_start(spark):
    texts = ["", "abc", "abcd", "a\t b  c😀d😀é", "Aaaaaa", LONG * 2]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.char_ngrams(F.col("t")).alias("g"))
    for t, g in rows.collect():
        low = re.sub(r"\s+", " ", t.lower())
        assert g == list(dict.fromkeys(low[i : i + 4] for i in range(len(low) - 3)))
    assert "substr" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_rollup_is_not_sorted(spark, tmp_path):
    from sievestone.plans.catalog import QUERIES

    docs = [(i, f"A title of more than five words {i}\n" + "information and here " * 60, f"src{i}") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found, all_ = QUERIES["research_pipeline"](spark, str(tmp_path)).collect(), QUERIES["research_rollup"](spark, str(tmp_path))
    assert [r["combined_score"] for r in found] == sorted((r["combined_score"] for r in found), reverse=True)
    assert all_.first()["articles"] == len(found) == 20
    assert "Sort [" not in all_._jdf.queryExecution().optimizedPlan().toString()
