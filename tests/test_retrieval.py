"""The retrieval index and the substring join against plain versions."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievestone.functions import constants as C
from sievestone.operators import retrieval, substring


def plain_search(docs: list[tuple], queries: list[tuple], k: int) -> set[tuple]:
    tokens = lambda t: [w for w in re.findall(r"\w{3,}", (t or "").lower()) if w not in C.RANKING_STOP_WORDS]
    df = Counter(w for _, t in docs for w in set(tokens(t)))
    unknown = math.log(100)

    def vector(t: str | None) -> dict[str, float]:
        v = {w: n * (math.log((len(docs) + 1) / (df[w] + 1)) + 1 if w in df else unknown) for w, n in Counter(tokens(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors, out = [(i, vector(t)) for i, t in docs], set()
    for q, text in queries:
        v = vector(text)
        scored = sorted((-round(sum(x * d[w] for w, x in v.items() if w in d), 6), i) for i, d in vectors if v.keys() & d.keys())
        out |= {(q, i, -s) for s, i in scored[:k]}
    return out


def corpus(n: int, queries: int) -> tuple[list, list]:
    r = random.Random(n)
    words = [f"word{int(r.paretovariate(0.7)) % 4000}" for _ in range(6000)]  # a few words are in most documents
    make = lambda low, high: " ".join(r.choice(words) for _ in range(r.randrange(low, high)))
    docs = [(i, make(0, 60)) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "the and of"), (n + 3, "wörter ωμέγα wörter")]
    docs += [(n + 10 + i, docs[7][1]) for i in range(9)]  # ties
    items = [(i, make(1, 25)) for i in range(queries)] + [(900, docs[7][1]), (901, None), (902, "never seen"), (903, "ωμέγα never"), (904, "word1")]
    return docs, items


@pytest.mark.parametrize(("block", "k", "together"), [(1024, 5, 512), (16, 3, 4), (16, 10_000, 512)])
def test_search_is_exact(spark, monkeypatch, block, k, together):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "TOGETHER", together)
    docs, items = corpus(700, 30)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = retrieval.build(rows, "doc_id", "text")
    got = retrieval.search(index, spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", k)
    assert {tuple(r) for r in got.collect()} == plain_search(docs, items, k)


def test_blocks_below_the_bound_are_not_searched(spark, monkeypatch):
    """One block has what the query asks for; others have its frequent word only."""
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    docs = [(i, f"common filler{i} other{i}") for i in range(400)] + [(1000 + i, f"rare{i} special common") for i in range(10)]
    index = retrieval.build(spark.createDataFrame(docs, "k long, t string").coalesce(1), "k", "t")
    asked = []
    evaluated = retrieval._evaluated
    monkeypatch.setattr(retrieval, "_evaluated", lambda i, a, pairs, *rest: asked.append(pairs.count()) or evaluated(i, a, pairs, *rest))
    queries = [(1, "special rare3 common")]
    got = retrieval.search(index, spark.createDataFrame(queries, "q long, t string"), "q", "t", 5)
    assert {tuple(r) for r in got.collect()} == plain_search(docs, queries, 5)
    assert asked[0] == retrieval.FIRST and asked[1] < 5 < index.rows.select("block").distinct().count()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "k long, t string"), spark.createDataFrame([(1, "some words")], "q long, t string")
    assert retrieval.search(retrieval.build(docs, "k", "t"), items, "q", "t", 5).count() == 0
    index = retrieval.build(items.toDF("k", "t"), "k", "t")
    assert retrieval.search(index, items.limit(0), "q", "t", 5).count() == 0


@pytest.mark.parametrize("bound", [200_000, 0])
def test_substrings(spark, monkeypatch, bound):
    monkeypatch.setattr(substring, "BROADCAST_NEEDLES", bound)
    r = random.Random(4)
    make = lambda a, b: "".join(r.choice("abAB.é") for _ in range(r.randrange(a, b)))
    texts = [make(0, 40) for _ in range(300)] + [None, "", "example.com", "EXAMPLE.COM/example.com"]
    needles = [*{make(0, 9) for _ in range(80)}, None, "", "example.com", "Example.com", "xample.co", "e", "not there at all"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = substring.containing(rows, "text", spark.createDataFrame([(n,) for n in [*needles, "e"]], "n string"), "n")
    want = {n: 0 if n is None else sum(n.lower() in t.lower() for t in texts if t is not None) for n in needles}
    assert {x["n"]: x["hits"] for x in got.collect()} == want and got.count() == len(set(needles))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert substring.containing(rows, "text", rows.limit(0), "text").count() == 0


def test_blocks_are_bounded_by_tokens(spark, monkeypatch):
    """Few long documents make as large a block as many short ones."""
    monkeypatch.setattr(retrieval, "TOKENS", 50, raising=False)
    monkeypatch.setattr(retrieval, "BATCH", 2, raising=False)
    docs, items = [(i, " ".join(f"word{(i * k) % 40}" for k in range(i % 30))) for i in range(120)] + [(500, "word1 " * 80)], [(1, "word1 word2 word7")]
    rows = spark.createDataFrame(docs, "k long, t string").coalesce(1)
    tokens = [sum(int.from_bytes(r["c"][p : p + 4], "little") for p in range(0, len(r["c"]), 4)) for r in retrieval._inverted(rows.selectExpr("k", "split(t, ' ') AS w")).collect()]
    assert sum(t > 50 for t in tokens) <= 1 and len(tokens) > 20
    got = retrieval.search(retrieval.build(rows, "k", "t"), spark.createDataFrame(items, "q long, t string"), "q", "t", 5)
    assert {tuple(r) for r in got.collect()} == plain_search(docs, items, 5)


def test_python_gets_one_block_at_a_time(spark, monkeypatch):
    """However many rows a partition has: texts for one block, and blocks one by one, not as objects of their terms."""
    real, given = retrieval.materialize, []
    monkeypatch.setattr(retrieval, "materialize", lambda df, rows=None: given.append((df.columns, rows)) or real(df, rows))
    docs, items = corpus(300, 4)
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    rows = spark.createDataFrame(docs, "k long, t string").coalesce(1)
    index = retrieval.build(rows, "k", "t")
    sizes = {tuple(c): n for c, n in given}
    assert sizes[("block", "ids", "terms", "dfs", "at", "c")] == 64 and sizes[tuple(index.rows.columns)] == 1
    got = retrieval.search(index, spark.createDataFrame(items, "q long, t string"), "q", "t", 5)
    assert {tuple(r) for r in got.collect()} == plain_search(docs, items, 5)
    n, each = 40_000, 5  # terms of one block
    names, numbers = pa.array([[f"term number {k}" for k in range(n)]]), np.arange(n * each)
    block = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([np.arange(4096, dtype="<i8").tobytes()]), names, pa.array([[each] * n], pa.list_(pa.int32())), pa.array([(numbers % 4096).astype("<u2").tobytes()]), pa.array([np.ones(n * each, "<u4").tobytes()]), pa.array([[1.5] * n])], ["block", "ids", "terms", "dfs", "at", "c", "idf"])
    tracemalloc.start()
    out = list(retrieval._postings(iter([block])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == n + 1 and peak < 60 * n * each, peak
