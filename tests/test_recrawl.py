from __future__ import annotations

import random

import numpy as np
import pytest

from sievestone.functions import constants as C
from sievestone.operators import frontier


def brute(rows: list[tuple]) -> dict:
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((t, d) for k, t, d in rows if k == key and t is not None)
        if not mine:
            continue
        i, changed, same = float(C.DEFAULT_INTERVAL), 0, 0
        for (_, a), (_, b) in zip(mine, mine[1:], strict=False):
            if a != b:
                i, changed = max(i / C.INTERVAL_FACTOR, float(C.MIN_INTERVAL)), changed + 1
            else:
                i, same = min(i * C.INTERVAL_FACTOR, float(C.MAX_INTERVAL)), same + 1
        out[key] = (float(mine[-1][0]), pytest.approx(i), pytest.approx(mine[-1][0] + i), changed, same)
    return out


def fold(spark, rows: list[tuple]) -> dict:
    df = spark.createDataFrame(rows, "url string, t double, digest string")
    return {r[0]: tuple(r)[1:] for r in frontier.recrawl_fold(df, "url", "t", "digest").collect()}


def test_hot_and_cold_keys(spark):
    r = random.Random(2)
    rows = [("hot", float(t), r.choice("aab")) for t in range(3000)] + [(f"u{r.randrange(300)}", float(r.randrange(50)), r.choice("ab")) for _ in range(900)]
    rows += [("same", float(t), "a") for t in range(700)] + [("new", float(t), str(t)) for t in range(700)] + [("one", 5.0, "a"), ("no time", None, "a"), (None, 3.0, "x"), (None, 4.0, "y")]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        assert fold(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert fold(spark, rows) == brute(rows)


def test_no_rows_and_no_digest(spark):
    assert fold(spark, []) == {}
    assert fold(spark, [("u", 1.0, None), ("u", 2.0, None), ("u", 3.0, "a")])["u"][3:] == (0, 2)


def test_long_runs_of_steps_compose():
    r = np.random.default_rng(4)
    for length in (1, 2, 3, 1000):
        changed = np.repeat(r.random(length) < 0.5, r.integers(1, 900, length))
        power = np.where(changed, -1, 1).astype(np.int64)
        low, high = np.where(changed, float(C.MIN_INTERVAL), 0.0), np.where(changed, np.inf, float(C.MAX_INTERVAL))
        k, a, b = frontier._composed(power.copy(), low.copy(), high.copy(), np.array([0]))
        for x in (float(C.MIN_INTERVAL), float(C.DEFAULT_INTERVAL), float(C.MAX_INTERVAL)):
            want = x
            for c in changed:
                want = max(want / C.INTERVAL_FACTOR, C.MIN_INTERVAL) if c else min(want * C.INTERVAL_FACTOR, C.MAX_INTERVAL)
            assert np.clip(frontier._scaled(np.array([x]), k), a, b)[0] == pytest.approx(want)
