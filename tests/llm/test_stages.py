"""Pipeline stages over rows without an id, rows that share one, and repeated rows."""

from __future__ import annotations

from collections import Counter

from sievestone.llm import near_dedup, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name: str) -> str:
    return " ".join(f"{name}{i}" for i in range(120))


def stage(spark, module, rows: list[tuple]) -> Counter:
    docs = spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t, source in rows], SCHEMA)
    out = module.pipeline_stage(spark, docs, "")
    assert out.columns == docs.columns
    return Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())


def test_quality_goes_by_row(spark):
    keep = [(1, words("a"), "x.com"), (None, words("b"), "x.com"), (None, words("c"), None), (2, words("d"), None), (3, words("e"), "x.com"), (3, words("e"), "x.com")]
    drop = [(1, "too short", "x.com"), (None, "too short", "x.com"), (None, None, None), (3, "", "x.com")]
    bad = [(100 + i, "too short", "bad.com") for i in range(300)]
    keep += [(i, words(f"g{i}"), "x.com") for i in range(10, 20)]
    same = [(1, words("a"), "bad.com")]  # the id and text of a kept row, from a rejected host
    assert stage(spark, quality_rules, [*keep, *drop, *bad, *same]) == Counter(keep)


def test_near_dedup_goes_by_row(spark):
    a, b, c, d = map(words, "abcd")
    rows = [(1, a), (1, a), (1, a + " tail"), (1, b), (5, a), (None, b + " tail"), (None, c), (None, c), (None, c + " tail"), (None, d), (7, None), (7, None), (8, "")]
    got = stage(spark, near_dedup, [(*x, "x.com") for x in rows])
    assert set(got.values()) == {1} and Counter((i, (t or "").removesuffix(" tail")) for i, t, _ in got) == Counter([(1, a), (1, b), (None, c), (None, d), (7, ""), (8, "")])
