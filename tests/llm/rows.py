"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, v long, block string, chunk string, n string, h string, bucket string"


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "größe", "x1", "zeta", "eta", "theta", "iota", "kappa"]
    make = lambda k: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(k))
    base = make(120)
    texts: list[str | None] = [None, "", " \n\t ", "a", "a  B", "\n\n", "x" * 3000, "ab " * 900, "é" * 60, base, base, base + " tail"]
    for _ in range(n - len(texts)):
        t = base.split(" ")
        for _ in range(r.randrange(1, 4)):
            t[r.randrange(len(t))] = f"zz{r.randrange(999)}"
        texts.append(" ".join(t) if r.random() < 0.5 else make(r.randrange(1, 90)) + "\n" + base[: r.randrange(0, 300)])
    rows = [(i, t, "en", "src0" if i % 3 else "src1", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], (len(rows), base.upper(), None, None, None), (None, base, "en", "src0", 3), (None, None, None, None, None)]
    return [(*x, "k", 1, "b", "c", "n", "h", "u") for x in rows]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
