"""Concordance of many keys: a key of few rows is one group, however many rows all keys have."""

import random

import pytest

from durata.constants import EVENT, TIME
from durata.operators import concordance as C


def brute(rows) -> float:
    wins = pairs = 0.0
    for t, e, r in rows:
        for t2, e2, r2 in rows:
            if e and (t < t2 or (t == t2 and not e2)):
                pairs += 1
                wins += 1.0 if r > r2 else 0.5 if r == r2 else 0.0
    return wins / pairs


def test_few_rows_a_key_are_not_cut(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, float(rng.randint(1, 9)), rng.randint(0, 1), rng.randint(0, 6) / 6) for k in range(4) for _ in range(50)]
    df = spark.createDataFrame(rows, f"key int, {TIME} double, {EVENT} long, prob_72h double")
    cut = C.concordance(df, ["key"], cuts=3, group_rows=60).collect()

    def no_cuts(*args, **kwargs):
        raise AssertionError("a key of few rows was cut")

    monkeypatch.setattr(C, "_pairs", no_cuts)
    whole = C.concordance(df, ["key"], group_rows=60).collect()
    for got in (cut, whole):
        for r in got:
            assert r.c_index == pytest.approx(brute([x[1:] for x in rows if x[0] == r.key]))
    assert len(cut) == len(whole) == 4
