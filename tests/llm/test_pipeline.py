"""The pipeline over rows with every oddity: each stage against a plain version of it, on what the stage before left."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from sievestone.llm import sentencepiece_codec
from sievestone.llm.shared import materialize

from .test_operators import LOW, groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows() -> tuple[list[tuple], list[tuple]]:
    r = random.Random(12)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "amet", "con", "sect", "él", "tur") for b in range(40)]
    make = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, make(20)) for i in range(4)] + [(9, None), (10, "")]
    shared, texts = make(30), [make(r.randrange(60, 140)) for _ in range(30)]
    docs = [*enumerate(texts), *((100 + i, texts[i] + " tail") for i in range(4)), *((200 + i, f"{make(40)} {shared} {make(40)}") for i in range(4)), (300, f"{make(50)}, {items[2][1].upper()}. {make(30)}")]
    docs += [(400, None), (401, ""), (402, "too short"), (403, "a b c " * 60), (None, make(80)), (None, texts[5]), (7, texts[7]), (8, make(70)), (500, make(6000))]
    return [(d, t, "en", f"src{k % 2}", len(t or "")) for k, (d, t) in enumerate(docs)], items


def quality(docs):
    def good(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(cover) <= 50 * len(w)

    return [x for x in docs if good(x[1])]


def near(docs):
    """The first of each group by (id, null last); of equal rows one."""
    docs = list(dict.fromkeys(docs))
    numbered = [(k, x[1]) for k, x in enumerate(sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)))]
    keep = {k for k, _, component, _ in groups(numbered, 5, 80) if k == component}
    return [x for k, x in enumerate(sorted(docs, key=lambda x: (x[0] is None, x[0] or 0))) if k in keep]


def passages(docs, w=50):
    least, key, out = {}, lambda x: 1 << 62 if x[0] is None else x[0], []
    for x in docs:
        b = x[1].encode()
        for i in range(len(b) - w + 1):
            least[b[i : i + w]] = min(least.get(b[i : i + w], 1 << 63), key(x))
    for x in docs:
        b, gone = x[1].encode(), bytearray(len(x[1].encode()))
        for i in range(len(b) - w + 1):
            if least[b[i : i + w]] < key(x):
                gone[i : i + w] = b"\1" * w
        chars, at = [], 0
        for c in x[1]:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                chars.append(c)
            at += n
        if chars:
            out.append((x[0], "".join(chars), *x[2:4], len(chars)))
    return out


def uncontaminated(docs, items):
    def distance(a, b):
        row = [0] * (len(b) + 1)
        for p in a:
            new = [row[0] + 1]
            for j, q in enumerate(b):
                new.append(min(row[j] + (p != q), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    asked = [words(t) for _, t in items if t]
    return [x for x in docs if all(distance(q, words(x[1])) > int(0.2 * len(q) + 1e-9) for q in asked)]


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_and_the_whole(spark, tmp_path, empty):
    docs, items = rows()
    docs = [] if empty else docs
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = [quality, near, passages, lambda x: uncontaminated(x, items), lambda x: x]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, plain, strict=True)):
        left = Counter(want([tuple(x) for x in now.collect()]))
        kept = materialize(stage(spark, now, str(tmp_path)), name)
        assert k == 4 or kept.columns == now.columns
        assert Counter(tuple(x)[:5] for x in kept.collect()) == left, name
        assert empty or name == "sentencepiece" or left != Counter(tuple(x) for x in now.collect()), name  # each has something to do
        now = kept
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(str, whole.collect())) == Counter(map(str, now.collect()))
    assert whole.filter("NOT lossless").count() == 0
    assert sentencepiece_codec.decode(whole, sentencepiece_codec.model_path()).filter("NOT decoded <=> text").count() == 0
