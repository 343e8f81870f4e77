"""Merkle manifest, source divergence and line dedup against plain versions, on rows with every oddity."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import divergence, line_dedup, merkle

from .rows import documents, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def got(df) -> Counter:
    return Counter(map(tuple, df.collect()))


# --- Merkle manifest
def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for nodes in tree[:-1]:
        run = i - i % 16
        out.append((nodes[run:i], nodes[i + 1 : run + 16]))
        i //= 16
    return out


def plain_manifest(rows: list[tuple]) -> Counter:
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    groups = defaultdict(list)
    for r in rows:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, r["text"] and r["text"].translate(LOW) if bad else r["text"]), r["doc_id"]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order]
    high = levels([t[-1][0] for t in trees])
    out = Counter()
    for g, s in enumerate(order):
        for i, (_, _, leaf_, shown, doc) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = siblings(trees[g], i) + siblings(high, g)
            acc = shown
            for before, after in steps:
                acc = H(*before, acc, *after)
            out[doc, leaf_, trees[g][-1][0], high[-1][0], H(*[x for b, a in steps for x in b + a]), acc, acc == high[-1][0]] += 1
    return out


def test_manifest(spark):
    rows = documents()
    rows += [(1000 + i, f"Text {i}", "en", "src2", i, *rows[0][5:]) for i in range(273)]  # a lone node at the end of two levels
    rows += [(2000 + i, f"Text {i}", "en", f"s{i:02}é", None, *rows[0][5:]) for i in range(30)]
    df = frame(spark, rows)
    result = got(merkle.manifest(df, {"text": merkle.tampered_text()}))
    assert result == plain_manifest(df.collect())
    assert {r[-1] for r in result} == {True, False}
    assert all(r[-1] for r in got(merkle.manifest(df)))
    assert got(merkle.manifest(df.limit(0))) == Counter()
    one = frame(spark, rows[:1])
    assert got(merkle.manifest(one)) == plain_manifest(one.collect())


def test_manifest_with_copied_nodes(spark, monkeypatch):
    """Nodes and groups' paths in several copies, and no broadcast, give the same proofs."""
    monkeypatch.setattr(merkle, "ASKED_BITS", 2)
    monkeypatch.setattr(merkle, "PATH_ROWS", 0)
    monkeypatch.setattr(merkle, "bounded_broadcast", lambda df, rows=0: df)
    rows = [(i, f"T{i}", "en", None if i % 3 else f"s{i % 5}", 1, *documents()[0][5:]) for i in range(700)]
    df = frame(spark, rows).repartition(5)
    assert got(merkle.manifest(df, {"text": merkle.tampered_text()})) == plain_manifest(df.collect())


# --- source divergence
def plain_divergence(rows: list, min_docs: int, top: int) -> Counter:
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        words = term.findall((r["text"] or "").translate(LOW))
        lang = r["lang"] or ""
        groups[lang, r["source"] or ""].update(words)
        df[lang].update(set(words))
    out = Counter()
    for lang in {k for k, _ in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= min_docs), key=str.encode)
        by_source = {s: c for (k, s), c in groups.items() if k == lang}

        def smooth(count: Counter, kept: list[str] = kept) -> dict[str, int]:
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: smooth(c) for s, c in by_source.items()}, smooth(sum(by_source.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, count in by_source.items():
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in by_source if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out.update((lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(ranked))
    return out


def talk(n: int) -> list[tuple]:
    r = random.Random(7)
    words = [f"{a}{b}" for a in ("été", "straße", "Word", "zz", "a") for b in "abcdefghij"]
    extra = documents()[0][5:]
    return [(i, " ".join(r.choices(words, k=r.randrange(30))) + " " + ("x" if i % 3 else "y") * 2, ("en", "fr", None)[i % 7 % 3], f"s{r.randrange(9)}" if i % 4 else "hot", 1, *extra) for i in range(n)]


def test_divergence(spark, monkeypatch):
    df = frame(spark, documents() + talk(300) + [(9000, "solo", "xx", "a", 1, *documents()[0][5:]), (9001, None, "xx", "b", 1, *documents()[0][5:])])
    want = plain_divergence(df.collect(), 10, 10)
    assert got(divergence.divergence(df)) == want and ("xx", "b", "pair", "a", 0, 1) in want
    monkeypatch.setattr(divergence, "CHUNK", 4)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert got(divergence.divergence(df, 3, 4)) == plain_divergence(df.collect(), 3, 4)
    assert got(divergence.divergence(df.limit(0))) == Counter()


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(300):
        total, kept = r.randrange(10**15), r.randrange(1, 10**9)
        count = r.randrange(total + 1)
        p = divergence.smoothed(np.array([count]), total, kept)[0]
        assert p == 1 + 10**9 * (count + 2) // (total + 2 * kept)
    assert divergence.smoothed(np.array([0]), 0, 1)[0] == 10**9 + 1
    assert divergence.distance(np.array([10**9 + 1]), np.array([1]))[0] == 10**18 // (10**9 + 2)


# --- line dedup
def plain_lines(rows: list, min_chars: int, min_docs: int) -> Counter:
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOW)
    held, last = Counter(), {}
    small = lambda d: (d is not None, d or 0)
    for r in rows:
        for k in {key(x) for x in (r["text"] or "").split("\n")}:
            held[k] += 1
            last[k] = max(last.get(k, (False, 0)), small(r["doc_id"]))
    out = Counter()
    for r in rows:
        lines = (r["text"] or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs or last[key(x)] == small(r["doc_id"])]
        out[r["doc_id"], "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    return out


def spoken(n: int) -> list[tuple]:
    r, extra = random.Random(5), documents()[0][5:]
    lines = [f"Line {i} " + "é" * 40 for i in range(60)] + ["short line", "", "é" * 39, " " * 50, "A common line that a third of all documents have somewhere."]
    make = lambda: "\n".join(r.choice((str.upper, str.lower, lambda x: f" \t{x}\r"))(r.choice(lines)) for _ in range(r.randrange(12)))
    return [(r.randrange(n) if i % 20 else None, make(), "en", "s", 1, *extra) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup(spark, monkeypatch, small):
    if small:  # many shards, in many copies, from small rows
        monkeypatch.setattr(line_dedup, "SHARD_LINES", 7)
        monkeypatch.setattr(line_dedup, "PAIRS", 20)
        monkeypatch.setattr(line_dedup, "HELD", 30)
    df = frame(spark, documents() + spoken(250)).repartition(7)
    want = plain_lines(df.collect(), 40, 5)
    assert got(line_dedup.line_dedup(df)) == want and any(n for *_, n in want)
    assert got(line_dedup.line_dedup(df, 5, 2)) == plain_lines(df.collect(), 5, 2)
    assert got(line_dedup.line_dedup(df.limit(0))) == Counter()


def test_line_index():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = r.integers(0, 2**64, (n, 2), np.uint64)
        counts, last = r.integers(5, 2**40, n), r.integers(-5, 99, n)
        index = line_dedup.LineIndex.load(line_dedup.LineIndex.build(keys, counts, last).dump())
        at = index.find(keys)
        assert sorted(at.tolist()) == list(range(n))
        assert (index.last[at] == last).all() and (index.counts[at] == np.minimum(counts, 2**32 - 1)).all()
        others = keys.copy()
        others[:, 1] ^= np.uint64(1)  # the same first half
        assert (index.find(others) == -1).all() and (index.find(r.integers(0, 2**64, (3000, 2), np.uint64)) == -1).all()


def test_query_columns(spark, tmp_path):
    frame(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    n = len(documents())
    assert merkle.query(spark, str(tmp_path)).count() == n
    done = line_dedup.query(spark, str(tmp_path))
    assert done.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert done.filter(F.col("doc_id") == 0).first()["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert dict(divergence.query(spark, str(tmp_path)).dtypes)["rank"] == "int"
