"""Catalogue queries over tables that are larger than a cut of the query would be."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from sievestone.functions import constants as C
from sievestone.plans import catalog
from sievestone.plans.catalog import QUERIES


def test_every_item_is_searched(spark, tmp_path):
    r = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(5, 60)))) for i in range(80)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(5, 30)))) for i in range(45)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    tokens = lambda t: [w for w in re.findall(r"\w{3,}", t.lower()) if w not in C.RANKING_STOP_WORDS]
    df = Counter(w for _, t in docs for w in set(tokens(t)))

    def vector(t):
        v = {w: n * (math.log((len(docs) + 1) / (df[w] + 1)) + 1 if w in df else math.log(100)) for w, n in Counter(tokens(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    want, vectors = [], {i: vector(t) for i, t in docs}
    for item, text in items:
        q = vector(text)
        near = [(-round(sum(x * v[w] for w, x in q.items() if w in v), 6), i) for i, v in vectors.items() if q.keys() & v.keys()]
        want += [(item, i, -c) for c, i in sorted(near)[:5]]
    got = QUERIES["query_doc_cosine_topk"](spark, str(tmp_path)).collect()
    assert len({x["item_id"] for x in got}) == 45 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("size", [20_000, 20])
def test_every_domain_is_joined(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(catalog, "BLOCK_DOMAINS", size, raising=False)
    urls = [f"https://d{i}.example.com/a/{j}" for i in range(70) for j in range(i % 3 + 1)]
    urls += ["https://www.d1.example.com/", "https://D5.example.com/x", "https://other.org/?from=d69.example.com", None, "no url"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    host = lambda u: None if u is None else m[1] if (m := re.match(r"[A-Za-z]+://([^/?#]*)", u)) else ""
    want = {h: 0 if h is None else sum(h.lower() in u.lower() for u in urls if u is not None) for h in map(host, urls)}
    got = QUERIES["domain_theta_join"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 75 and {r["domain"]: r["pages"] for r in got} == want
