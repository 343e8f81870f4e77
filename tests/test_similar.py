"""Similar pairs by prefixes of rare terms against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sievestone.operators import ranking


def rows(n: int) -> list[tuple]:
    r = random.Random(n)
    topics = [[f"topic{t}word{i}" for i in range(25)] for t in range(12)]
    text = lambda: "everywhere " + " ".join(r.choices(r.choice(topics), k=r.randrange(3, 25)) + r.choices(["shared", "alsoshared", "thirdshared"], k=r.randrange(4)))
    return [(i, text()) for i in range(n)] + [(n, "everywhere"), (n + 1, "everywhere everywhere"), (n + 2, None), (n + 3, "")]


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.7, 0.99])
def test_pairs_are_exact(spark, threshold):
    docs = spark.createDataFrame(rows(150), "k long, t string")
    vectors: dict[int, dict[str, float]] = {}
    for x in ranking.vectors(docs, "k", "t", ranking.vocabulary(docs, "k", "t")).collect():
        vectors.setdefault(x["k"], {})[x["term"]] = x["w"]
    want = {}
    for a, va in vectors.items():
        for b, vb in vectors.items():
            if a < b and (c := math.fsum(w * vb[t] for t, w in va.items() if t in vb)) >= threshold - 1e-12:
                want[a, b] = c
    got = {(x["a"], x["b"]): x["cosine"] for x in ranking.similar_pairs(docs, "k", "t", threshold).collect()}
    clear = {p for p, c in want.items() if abs(c - threshold) > 1e-9}
    assert clear <= got.keys() <= want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert want


def test_a_term_of_every_document_joins_nothing(spark):
    """All documents share a word; only those that have nothing else meet by it."""
    docs = spark.createDataFrame(rows(150), "k long, t string")
    idf = ranking.vocabulary(docs, "k", "t")
    v = ranking.vectors(docs, "k", "t", idf)
    prefix = ranking.prefix_terms(v, idf, "k", 0.35)
    assert {x["k"] for x in prefix.filter("term = 'everywhere'").collect()} == {150, 151}
    held = prefix.groupBy("term").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert held < 60 < v.groupBy("term").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert ranking.similar_pairs(docs.limit(0), "k", "t", 0.35).count() == 0
