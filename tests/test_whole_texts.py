"""Queries that read whole texts, however long these are."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import pytest

from sievestone.functions import text as T
from sievestone.plans.catalog import QUERIES

#: Texts with one beginning of over 8,000 characters, which differ behind it; the last two are near each other.
HEAD = "the same beginning of them all " * 300
TAILS = [" ".join(random.Random(k).choices([f"word{k}x{i}" for i in range(400)], k=9000)) for k in range(3)]
TEXTS = {1: HEAD + TAILS[0], 2: HEAD + TAILS[1], 3: HEAD + TAILS[2], 4: HEAD + TAILS[2] + " end", 5: "short\ntext", 6: "", 7: None}


def plain(text):
    words = re.sub(r"[^a-z0-9\s]", " ", (text or "").lower()).split()
    votes = [0] * 64
    for token in words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]:
        h = int(hashlib.md5(token.encode()).hexdigest()[16:], 16)
        votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, t, "en" if k % 2 else "de") for k, t in TEXTS.items()], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


PRINTS = {k: plain(t) for k, t in TEXTS.items()}
APART = {(a, b): (PRINTS[a] ^ PRINTS[b]).bit_count() for a, b in combinations(PRINTS, 2)}


@pytest.mark.parametrize("name, distance", [("simhash_near_pairs", 3), ("simhash_duplicate_pairs", 9)])
def test_pairs_are_of_whole_texts(spark, folder, name, distance):
    got = {(r["a"], r["b"]): r["distance"] for r in QUERIES[name](spark, folder).collect()}
    assert got == {p: d for p, d in APART.items() if d <= distance} and (3, 4) in got and (1, 2) not in got


def test_classes_are_of_whole_texts(spark, folder):
    got = {r["doc_id"]: (r["class_id"], r["copies"], r["links"]) for r in QUERIES["fingerprint_classes"](spark, folder).collect()}
    copies = {v: [k for k in PRINTS if PRINTS[k] == v] for v in PRINTS.values()}
    links = lambda v: sum(v != w and (v ^ w).bit_count() <= 9 for w in copies)
    assert got == {k: (min(copies[v]), len(copies[v]), links(v)) for k, v in PRINTS.items()}


def test_ranking_is_of_whole_texts(spark, tmp_path):
    far = "filler words only " * 500
    docs = [(1, far), (2, far + "the nation on the other hand"), (3, "nothing here")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["semantic_rank"](spark, str(tmp_path)).collect()}
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)}
    asked = grams("the nation on the other hand")
    assert got[1]["cosine"] == 0 < got[2]["cosine"]
    assert all(got[k]["jaccard"] == round(len(asked & grams(t)) / len(asked | grams(t)), 6) for k, t in docs)


def test_long_texts_are_summed_in_parts(spark):
    rows = spark.createDataFrame([*TEXTS.items()], "k long, t string")
    assert {r["k"]: r["simhash"] & ((1 << 64) - 1) for r in T.simhash(rows, "k", "t", head=None).collect()} == PRINTS
