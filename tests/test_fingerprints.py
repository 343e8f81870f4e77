from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from sievestone.operators.fingerprints import LOOKUPS, FingerprintIndex, _near, shape


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def values(n: int, seed: int = 3) -> list[int]:
    """Made in families: a value, and others 1 to 12 bits from it."""
    r, out = random.Random(seed), []
    while len(out) < n:
        base = r.getrandbits(64)
        out.append(base)
        for _ in range(r.randrange(4)):
            x = base
            for b in r.sample(range(64), r.randrange(1, 13)):
                x ^= 1 << b
            out.append(x)
    return [signed(x) for x in out[:n]]


def brute(v: list[int], distance: int = 9) -> set[tuple[int, int, int]]:
    first = {}
    for k, x in enumerate(v):
        first.setdefault(x, k)
    apart = lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count()
    return {(*sorted((first[x], first[y])), apart(x, y)) for x, y in combinations(first, 2) if apart(x, y) <= distance}


@pytest.mark.parametrize("expected", [10, 10**4, 10**6, 10**9])
def test_shape(expected):
    parts = shape(expected)
    assert sum(w for _, w, _ in parts) == 64 and sum(r + 1 for _, _, r in parts) == 10
    assert sum(_near(w, r) for _, w, r in parts) <= LOOKUPS


@pytest.mark.parametrize("expected", [10**4, 10**6])
def test_batches_give_what_one_gives(spark, tmp_path, expected):
    v = values(240)
    v += v[:40] + [v[7]] * 30 + [0, -1]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id long, f long")
    got = []
    for name, cuts in (("one", [0, len(v)]), ("many", [0, 100, 100, 250, len(v)])):
        index = FingerprintIndex.open(spark, str(tmp_path / name), f"f_{name}_{expected}", expected, buckets=4)
        for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            index.add(rows.filter(f"id >= {a} AND id < {b}"), number, "id", "f")
        assert index.table("classes").groupBy("fingerprint").count().count() == len(set(v))
        got.append({tuple(r) for r in index.pairs().collect()})
        assert index.pairs().count() == len(got[-1])  # no pair twice
        copies = {r["class_id"]: r["copies"] for r in index.classes().collect()}
        assert copies[7] == 32 and sum(copies.values()) == len(v)
        index.drop()
    assert got[0] == got[1] == brute(v)


def test_repeated_batch_and_new_session_state(spark, tmp_path):
    v = values(60, 5)
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v)] + [(99, None)], "id long, f long")
    first = FingerprintIndex.open(spark, str(tmp_path), "f_first", 1000, buckets=4)
    first.add(rows.filter("id < 30"), 0, "id", "f")
    first.add(rows.filter("id >= 30"), 1, "id", "f")
    first.add(rows.filter("id >= 30"), 1, "id", "f")
    again = FingerprintIndex.open(spark, str(tmp_path), "f_again", 1000, buckets=4)  # the same files under another name
    assert {tuple(r) for r in again.pairs().collect()} == brute(v)
    assert again.table("keys").count() == len(set(v)) * len(again.parts)
    again.add(rows.filter("id < 0"), 2, "id", "f")
    assert again.pairs().count() == len(brute(v))


def test_hot_keys_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sievestone.operators.fingerprints.SHARE", 16)
    r = random.Random(1)
    v = sorted({signed(r.getrandbits(20) << 44) for _ in range(300)})  # equal in their low bits
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id long, f long")
    index = FingerprintIndex.open(spark, str(tmp_path), "f_hot", 1000, buckets=4)
    index.add(rows.filter("id % 3 = 0"), 0, "id", "f")
    index.add(rows.filter("id % 3 > 0"), 1, "id", "f")
    assert index.table("keys").groupBy("key", "salt").count().agg({"count": "max"}).first()[0] < 60
    assert {tuple(p) for p in index.pairs().collect()} == brute(v)


def test_history_is_not_shuffled(spark, tmp_path):
    index = FingerprintIndex.open(spark, str(tmp_path), "f_plan", 1000, buckets=8)
    index.add(spark.createDataFrame([(k, x) for k, x in enumerate(values(50))], "id long, f long"), 0, "id", "f")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.candidates(spark.createDataFrame([(5,)], "fingerprint long"), 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(line for line in plan.splitlines() if "f_plan_keys" in line)
    above = plan[: plan.index(scan)].splitlines()
    assert "Bucketed: true" in scan and not any("Exchange" in line for line in above[-3:]), plan
    assert plan.count("SortMergeJoin") >= 1


@pytest.mark.parametrize("cheap", [10**9, 1e-9])
def test_links_are_counted_in_blocks_or_by_look_ups(spark, tmp_path, monkeypatch, cheap):
    """Both give each value's links with older and with new values; what is stored grows with the values, not with a family's pairs."""
    for name, x in (("CHEAP", cheap), ("GRID", 3), ("LEAST", 40), ("TILE", 32)):
        monkeypatch.setattr(f"sievestone.operators.fingerprints.{name}", x, raising=False)
    v = values(240, 8) + [signed(0xABCDEF << 40 | 1 << a | 1 << b) for a in range(24) for b in range(a)] + [0, -1]  # all pairs of the family are links
    want = Counter(i for a, b, _ in brute(v) for i in (a, b))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id long, f long")
    ways, real = [], FingerprintIndex._in_blocks
    monkeypatch.setattr(FingerprintIndex, "_in_blocks", lambda *a: ways.append(1) or real(*a))
    index = FingerprintIndex.open(spark, str(tmp_path), f"f_counts_{len(str(cheap))}", 1000, buckets=4)
    for number in (0, 1, 1, 2):
        index.add(rows.filter(f"id % 3 = {number}"), number, "id", "f")
    assert {r["class_id"]: r["links"] for r in index.classes().collect()} == {k: want[k] for k in range(len(v))}
    assert {tuple(p) for p in index.pairs().collect()} == brute(v) and sum(want.values()) > 60 * len(v)
    stored = sum(spark.table(t.name).count() for t in spark.catalog.listTables() if t.name.startswith(index.name))
    assert stored < 20 * len(v) and len(ways) == (4 if cheap > 1 else 0), (stored, ways)
    index.drop()
