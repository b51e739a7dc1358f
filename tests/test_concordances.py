"""C-indices of many risks against the same times, without a row per risk."""

import numpy as np
import pytest

from durata.operators.concordance import Cuts, concordances


def brute(t, e, r):
    good = tied = pairs = 0
    for i in range(len(t)):
        if not e[i]:
            continue
        after = (t > t[i]) | ((t == t[i]) & (e == 0))
        pairs += after.sum()
        good += (r[i] > r[after]).sum()
        tied += (r[i] == r[after]).sum()
    return (good + 0.5 * tied) / pairs if pairs else None


@pytest.mark.parametrize("cuts", [None, 3, 64])
def test_against_brute_force(spark, cuts):
    rng = np.random.default_rng(3)
    n = 700
    t = np.where(rng.random(n) < 0.4, 72.0, np.round(rng.random(n) * 72, 1))
    e = (rng.random(n) < 0.5).astype(int)
    risks = [rng.random(n), np.round(rng.random(n), 1), np.where(rng.random(n) < 0.5, 0.3, rng.random(n)), np.zeros(n), 1 - t / 100]
    rows = [(float(a), int(b), *map(float, r)) for a, b, *r in zip(t, e, *risks, strict=True)]
    odd = [(None, 1, *[0.5] * 5), (float("nan"), 1, *[0.5] * 5), (3.0, None, *[0.5] * 5)]
    names = ", ".join(f"x{i} double" for i in range(5))
    df = spark.createDataFrame(rows + odd, f"time_to_hit_hours double, event int, {names}").repartition(3)
    got = concordances(df, [f"x{i}" for i in range(5)], cuts=cuts, turn=2)
    assert got == pytest.approx([brute(t, e, r) for r in risks], abs=1e-12)


def test_nothing_comparable(spark):
    df = spark.createDataFrame([(5.0, 0, 0.1), (9.0, 0, 0.3)], "time_to_hit_hours double, event int, x double")
    assert concordances(df, ["x"]) == [None]
    assert concordances(df.where("x > 1"), ["x"]) == [None]


def test_heavy_values_lie_alone():
    cuts = Cuts.of(np.array([1.0, 2.0, 2.0, 5.0]))
    b = cuts.bucket(np.array([0.0, 1.5, 2.0, np.nextafter(2.0, 3), 5.0]))
    assert b.tolist() == [0, 1, 2, 3, 4] and cuts.lone[b].tolist() == [False, False, True, False, False]
