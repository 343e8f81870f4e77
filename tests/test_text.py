"""Fingerprints and signals against plain versions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from sievestone.functions import constants as C
from sievestone.functions import text as T

TEXTS = ["", None, "one", "One two, three!\tone two", "Ünïcode wörds 123 and so on\n" * 40, "w" * 20_000, "word " * 5_000, "-- !!", "The FED RATE and an İPO; Price Target. $3 Billion; revenue of $5 was 4.5% Growth"]


def plain(text):
    words = re.sub(r"[^a-z0-9\s]", " ", (text or "").lower()[:8000]).split()
    votes = [0] * 64
    for token in words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]:
        h = int(hashlib.md5(token.encode()).hexdigest()[16:], 16)
        votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
    return f"{sum(1 << b for b, v in enumerate(votes) if v > 0):016x}"


def test_simhash(spark):
    rows = [(k // 2, t) for k, t in enumerate(TEXTS)]
    got = T.simhash(spark.createDataFrame(rows, "k long, t string"), "k", "t").select("k", T.simhash_hex(F.col("simhash")))
    assert sorted(map(tuple, got.collect())) == sorted((k, plain(t)) for k, t in rows)


def test_signals(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.signals(F.col("t")).alias("s"))
    want = lambda t: sorted({kind for p, kind in C.SIGNALS if re.search(p, t[:5000], re.IGNORECASE | re.ASCII)})
    assert all(r.s == want(r.t) for r in df.collect() if r.t is not None) and max(len(r.s or []) for r in df.collect()) > 3
