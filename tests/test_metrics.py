import itertools
import math
import random

import numpy as np
import pytest

from durata.operators.concordance import concordance, count_pairs
from durata.operators.metrics import (
    all_metrics,
    auc,
    brier_censor_aware,
    calibration_gap,
    calibration_curve,
    hybrid_score,
    weighted_brier,
)

COLS = "event_id long, event long, time_to_hit_hours double, prob_12h double, prob_24h double, prob_48h double, prob_72h double"


def frame(spark, rows):
    """rows: (event, time, probabilities or one probability)."""
    out = []
    for i, (e, t, p) in enumerate(rows):
        p = [p] * 4 if isinstance(p, float) else p
        out.append((i, e, float(t), *map(float, p)))
    return spark.createDataFrame(out, COLS)


def brier24(spark, rows):
    return frame(spark, rows).agg(brier_censor_aware(24).alias("b")).first()["b"]


def test_censored_before_horizon_is_left_out(spark):
    assert brier24(spark, [(0, 10, 0.5), (1, 5, 1.0), (0, 50, 0.0), (1, 30, 0.0)]) == 0


def test_hit_after_horizon_counts_as_zero(spark):
    assert brier24(spark, [(1, 10, 1.0), (1, 40, 0.0)]) == 0


def test_censored_after_horizon(spark):
    assert brier24(spark, [(0, 50, 0.3)]) == pytest.approx(0.09)


def test_nothing_left_is_null(spark):
    assert brier24(spark, [(0, 5, 0.5), (0, 10, 0.5)]) is None


def test_censored_exactly_at_horizon_counts_unless_asked(spark):
    df = frame(spark, [(0, 24, 0.4)])
    assert df.agg(brier_censor_aware(24).alias("b")).first()["b"] == pytest.approx(0.16)
    assert df.agg(brier_censor_aware(24, boundary="exclude").alias("b")).first()["b"] is None


def test_weights(spark):
    row = weighted_brier(frame(spark, [(1, 50, [0, 0, math.sqrt(0.1), 1])])).first()
    assert (row["brier_24h_ca"], row["brier_72h_ca"]) == (0, 0)
    assert row["brier_48h_ca"] == pytest.approx(0.1)
    assert row["weighted_brier"] == pytest.approx(0.04)


def test_perfect_predictions(spark):
    rows = [(1, 18, [0, 1, 1, 1]), (1, 40, [0, 0, 1, 1]), (0, 72, [0, 0, 0, 0])]
    assert weighted_brier(frame(spark, rows)).first()["weighted_brier"] == 0


@pytest.mark.parametrize(("risks", "expected"), [((0.9, 0.6, 0.3), 1.0), ((0.3, 0.6, 0.9), 0.0)])
def test_concordance_extremes(spark, risks, expected):
    rows = [(1, t, r) for t, r in zip((10, 20, 30), risks, strict=True)]
    assert concordance(frame(spark, rows)).first()["c_index"] == expected


def brute_pairs(data):
    conc = tied = comp = 0
    for (ei, ti, ri), (ej, tj, rj) in itertools.permutations(data, 2):
        if ei == 1 and (ti < tj or (ti == tj and ej == 0)):
            comp += 1
            conc += ri > rj
            tied += ri == rj
    return conc, tied, comp


def random_rows(seed, n):
    rng = random.Random(seed)
    # a third of all rows share the last time, times and risks are heavily tied
    return [
        (0, 72.0, rng.randint(0, 9) / 10) if rng.random() < 0.33
        else (rng.randint(0, 1), float(rng.randint(0, 12)), rng.randint(0, 9) / 10)
        for _ in range(n)
    ]


def test_count_pairs_against_brute_force():
    for seed in range(30):
        data = random_rows(seed, 60)
        _, pos = np.unique([t * 2 + (1 - e) for e, t, _ in data], return_inverse=True)
        _, risk = np.unique([r for _, _, r in data], return_inverse=True)
        got = count_pairs(pos, risk, np.array([float(e) for e, _, _ in data]), np.ones(60))
        assert got == brute_pairs(data)


@pytest.mark.parametrize("kwargs", [{}, {"cuts": 4, "group_rows": 10**6}, {"cuts": 3, "group_rows": 12}])
def test_concordance_paths_agree_with_brute_force(spark, kwargs):
    """One group, one bucket level, and repeated cutting of oversized buckets."""
    sets = {"a": random_rows(1, 150), "b": random_rows(2, 150)}
    rng = random.Random(3)
    sets["c"] = [(rng.randint(0, 1), rng.choice([5.0, rng.random() * 70]), rng.random()) for _ in range(150)]
    rows = [(m, e, t, r) for m, data in sets.items() for e, t, r in data]
    df = spark.createDataFrame(rows, "model string, event long, time_to_hit_hours double, prob_72h double")
    got = {r["model"]: (r["concordant"], r["tied"], r["comparable"]) for r in concordance(df, ["model"], **kwargs).collect()}
    assert got == {m: brute_pairs(data) for m, data in sets.items()}


def test_no_comparable_pair_gives_null(spark):
    assert concordance(frame(spark, [(0, 5, 0.1), (0, 9, 0.3)])).first()["c_index"] is None


def test_auc_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(1, 72), rng.randint(0, 8) / 8) for _ in range(200)]
    got = {r["horizon"]: r["auc"] for r in auc(frame(spark, rows)).collect()}
    for h in (12, 24, 48, 72):
        pos = [p for e, t, p in rows if e == 1 and t <= h]
        neg = [p for e, t, p in rows if not (e == 1 and t <= h)]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[h] == pytest.approx(wins / len(pos) / len(neg))


def test_auc_with_one_class_is_null(spark):
    rows = auc(frame(spark, [(1, 5, 0.2), (1, 6, 0.4)])).collect()
    assert all(r["auc"] is None for r in rows)


def test_calibration_gap_needs_forty_rows(spark):
    rows = [(i % 2, 10 + i, 0.5) for i in range(39)]
    df = frame(spark, rows)
    assert calibration_gap(calibration_curve(df)).first()[0] is None
    df = frame(spark, [*rows, (1, 3, 0.5)])
    assert calibration_gap(calibration_curve(df)).first()[0] == pytest.approx(abs(20 / 40 - 0.5))


def test_hybrid_combines_components(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), rng.randint(1, 72), sorted(rng.random() for _ in range(4))) for _ in range(80)]
    df = frame(spark, rows)
    h = hybrid_score(df).first()
    assert h["hybrid_score"] == pytest.approx(0.3 * h["c_index"] + 0.7 * (1 - h["weighted_brier"]))
    wide = all_metrics(df).first().asDict()
    assert wide["hybrid_score"] == pytest.approx(h["hybrid_score"])
    for key in ("brier_mean", "auc_12h", "logloss_72h", "calibration_gap_72h", "brier_12h_naive"):
        assert wide[key] is not None
