"""Quantiles and cuts per key, bounded aggregates, weight search by second moments."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from durata.constants import HORIZONS
from durata.operators.concordance import concordance
from durata.operators.ensemble import (
    error_moments,
    members_wide,
    optimize_weights,
    score_by_moments,
    score_candidates,
    simplex_grid,
)
from durata.operators.metrics import auc, calibration_curve
from durata.models.marginal import KaplanMeierModel
from durata.models.trees import FoldBins, training_table
from durata.models.validation import oof_predictions
from durata.operators.quality import psi
from durata.operators.quantiles import exact_quantiles, keyed_quantiles
from durata.operators.scan import POINTS, equi_depth_splits_of, sketched_quantiles
from durata.operators.selection import mutual_information
from durata.operators.stats import describe_by

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small", [50, 10**6])
def test_keyed_quantiles_against_numpy(spark, small):
    """Thousands of groups, a hot one, ties, keys with ranges of their own, null keys and values."""
    rng, groups = random.Random(8), {}
    for g in range(2000):
        groups[f"g{g}", g % 3] = [g * 10 + rng.randint(0, 4) + rng.random() for _ in range(rng.randint(1, 4))]
    groups["hot", 0] = [rng.choice([0.5, rng.gauss(100, 50)]) for _ in range(3000)]
    groups[None, 1] = [rng.random() for _ in range(40)]
    groups["one", None] = [7.0] * 30
    rows = [(a, b, v) for (a, b), vs in groups.items() for v in vs] + [("hot", 0, None), ("void", 0, None)]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(7)
    got = {(r.a, r.b): r.quantiles for r in keyed_quantiles(df, ["a", "b"], "v", PROBS, small).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, PROBS)), abs=1e-9)
    whole = keyed_quantiles(df, [], "v", PROBS, small).first()[0]
    assert whole == pytest.approx(list(np.quantile([v for _, _, v in rows if v is not None], PROBS)))
    assert keyed_quantiles(df.limit(0), ["a"], "v", PROBS, small).count() == 0


def test_exact_quantiles_in_bounded_batches(spark):
    rng = random.Random(9)
    rows = [tuple(rng.choice([rng.random(), 0.25]) for _ in range(5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    for small in (60, 500, 900, 10**6):
        got = exact_quantiles(df, {c: F.col(c) for c in "abcde"}, PROBS, small)
        for i, c in enumerate("abcde"):
            assert got[c] == pytest.approx(list(np.quantile([r[i] for r in rows], PROBS)))


def test_describe_by_many_groups(spark):
    rng = random.Random(4)
    rows = [(g, rng.random(), None if g % 5 == 0 else rng.random()) for g in range(1200) for _ in range(3)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0)], "g int, x double, y double")
    got = {(r.g, r.feature): r for r in describe_by(df, "g", ["x", "y"]).collect()}
    assert len(got) == 2400
    for g in (0, 7, 1199):
        x = [r[1] for r in rows if r[0] == g]
        r = got[g, "x"]
        assert (r["count"], r["q50"]) == (3, pytest.approx(np.median(x))) and r["q25"] == pytest.approx(np.quantile(x, 0.25))
    assert got[0, "y"]["count"] == 0 and got[0, "y"]["q50"] is None


def scored(spark, keys=300, each=6):
    """Keys whose scores lie in ranges of their own."""
    rng, rows = random.Random(6), []
    for k in range(keys):
        for i in range(each):
            p = [k / keys + rng.random() / keys for _ in HORIZONS]
            rows.append((None if k == 0 else k, i % 2, rng.choice([6.0, 30.0, 60.0, 80.0]), *sorted(p)))
    probs = ", ".join(f"prob_{h}h double" for h in HORIZONS)
    return rows, spark.createDataFrame(rows, f"key int, event long, time_to_hit_hours double, {probs}")


def test_auc_and_calibration_of_many_keys(spark):
    rows, df = scored(spark)
    areas = {(r.key, r.horizon): r.auc for r in auc(df.where("key is not null"), ["key"]).collect()}
    curve = {}
    for r in calibration_curve(df, ["key"], bins=3).collect():
        curve.setdefault((r.key, r.horizon), {})[r.bin] = (r.n, r.mean_pred, r.frac_pos)
    assert len(curve) == 300 * len(HORIZONS)
    for k in (None, 1, 150, 299):
        for n, h in enumerate(HORIZONS):
            own = [(r[3 + n], int(r[1] == 1 and r[2] <= h)) for r in rows if r[0] == k]
            pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
            if k is not None:
                want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg) if pos and neg else None
                assert areas[k, h] == (None if want is None else pytest.approx(want))
            inner = np.quantile([p for p, _ in own], [1 / 3, 2 / 3])
            want = {}
            for p, y in own:
                want.setdefault(int((p > inner).sum()), []).append((p, y))
            assert curve[k, h] == {
                b: (len(v), pytest.approx(np.mean([p for p, _ in v])), pytest.approx(np.mean([y for _, y in v]))) for b, v in want.items()
            }


def members(spark, monotone=True):
    rng, rows = random.Random(3), []
    for i in range(160):
        e, t = rng.randint(0, 1), rng.choice([6.0, 12.0, 30.0, 60.0, 80.0])
        for m in "abc":
            p = [rng.random() for _ in HORIZONS]
            rows.append((i, m, e, t, *(sorted(p) if monotone else p)))
    probs = ", ".join(f"prob_{h}h double" for h in HORIZONS)
    return spark.createDataFrame(rows, f"event_id long, model string, event long, time_to_hit_hours double, {probs}")


@pytest.mark.parametrize("objective", ["hybrid", "brier"])
def test_moments_score_as_rows_do(spark, objective):
    wide = members_wide(members(spark), list("abc"), ["time_to_hit_hours", "event"])
    moments = error_moments(wide, 3, objective == "hybrid")
    grid = simplex_grid(3, 5)
    assert len(grid) > 16
    want = score_candidates(wide, list("abc"), grid, objective)
    assert score_by_moments(wide, moments, grid, objective) == pytest.approx(want, abs=1e-12)


def test_members_that_are_repaired_go_by_rows(spark):
    df = members(spark, monotone=False)
    assert error_moments(members_wide(df, list("abc"), ["time_to_hit_hours", "event"]), 3, True) is None
    weights = optimize_weights(df, list("abc"), "brier", rounds=1)
    assert sum(weights.values()) == pytest.approx(1)


def test_concordance_lets_go_of_its_rows(spark):
    rows, df = scored(spark, 3, 40)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = held().size()
    for _ in range(3):
        assert concordance(df.where("key is not null"), ["key"], cuts=3, group_rows=20).count() == 2
    assert held().size() - before <= 3


def test_exact_quantiles_passes_do_not_grow(spark, monkeypatch):
    """Many columns and probabilities beyond the limit: a few passes, bits as ``percentile``."""
    rng = random.Random(15)
    rows = [tuple(rng.choice([rng.gauss(0, 1), 0.5, None]) for _ in range(8)) for _ in range(900)]
    names = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    probs, wide = [i / 16 for i in range(17)], []
    plain = type(df).agg

    def agg(self, *exprs):
        wide.append(len(exprs))
        return plain(self, *exprs)

    monkeypatch.setattr(type(df), "agg", agg)
    got = exact_quantiles(df, {c: F.col(c) for c in names}, probs, small=20)
    assert max(wide) <= len(names) and len(wide) <= 4
    monkeypatch.undo()
    assert got == exact_quantiles(df, {c: F.col(c) for c in names}, probs, small=10**6)


def test_bins_of_wide_tables_are_counted_per_task(spark):
    """PSI and mutual information against numpy, with missing values and a constant column."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3)).round(1)
    x[rng.random((700, 3)) < 0.1] = np.nan
    y, side = np.where(x[:, 0] > 0, x[:, 1], rng.normal(size=700)), rng.random(700) < 0.6
    data = [(*map(float, r), 4.0, float(t), bool(s)) for r, t, s in zip(x, y, side, strict=True)]
    df = spark.createDataFrame(data, "a double, b double, c double, one double, t double, base boolean").repartition(4)

    def binned(v, edges):
        return np.searchsorted(np.unique(edges)[1:-1], v, "left")

    got = {r.feature: r.psi for r in psi(df.where("base"), df.where("not base"), ["a", "b", "c", "one"]).collect()}
    scores = {r.feature: r.mi_score for r in mutual_information(df, ["a", "b", "c", "one"], "t").collect()}
    assert got["one"] == 0 and scores["one"] == pytest.approx(0, abs=1e-12)
    for j, c in enumerate("abc"):
        p, q = ([x[s & ~np.isnan(x[:, j]), j]] for s in (side, ~side))
        edges = np.quantile(p[0], np.arange(11) / 10)
        p, q = (np.maximum(np.bincount(binned(v[0], edges), minlength=10) / len(v[0]), 1e-6) for v in (p, q))
        assert got[c] == pytest.approx(((p - q) * np.log(p / q)).sum())
        known, seen = ~np.isnan(x[:, j]), ~np.isnan(y)
        both = known & seen
        cut = [np.quantile(v, np.arange(17) / 16) for v in (x[known, j], y[seen])]
        n, _, _ = np.histogram2d(binned(x[both, j], cut[0]), binned(y[both], cut[1]), bins=[np.arange(17), np.arange(17)])
        n /= n.sum()
        expected = np.outer(n.sum(1), n.sum(0))
        assert scores[c] == pytest.approx((n[n > 0] * np.log(n[n > 0] / expected[n > 0])).sum())


def test_cuts_of_many_columns_meet_in_groups_of_their_own(spark):
    """Cut points within their share of the ranks: skew, ties, missing and infinite values, no values."""
    rng = np.random.default_rng(5)
    x = np.column_stack([np.sort(rng.lognormal(size=40_000)), rng.integers(0, 3, 40_000), np.full(40_000, np.nan)])
    x[:50, 0], x[-50:, 0] = np.nan, np.inf
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).repartition(6)
    found = sketched_quantiles(df, ["a", "b", "c"], [[0.1, 0.5, 0.9], [0.5], [0.5]])
    known = np.sort(x[50:, 0])
    assert np.abs(np.searchsorted(known, found[0]) / len(known) - [0.1, 0.5, 0.9]).max() < 2 / POINTS
    assert found[1].tolist() == [1.0] and len(found[2]) == 0
    assert np.isfinite(equi_depth_splits_of(df, ["a", "b", "c"], 50)[0]).all()


def test_training_tables_have_a_partition_a_core(spark):
    """Tables in many small partitions, or in one, are passed over by one task a core."""
    rows = [(i, float(i % 7), 1.0 + i % 11, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, x double, time_to_hit_hours double, event int")
    cores = spark.sparkContext.defaultParallelism
    for parts in (1, 5 * cores):
        cut = df.repartition(parts)
        bins = FoldBins.fit(cut, ["x"], [-1], "-2", 8)
        for order in (None, "t"):
            table = training_table(cut, bins, {"t": "time_to_hit_hours"}, 1, order=order)
            assert table.partitions == cores and table.df.count() == 300
            table.df.unpersist()


def test_fold_predictions_have_few_partitions(spark):
    """Predictions of k folds lie in k partitions a core, however the rows came."""
    rows = [(i, float(i % 7), 1.0 + i % 50, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, x double, time_to_hit_hours double, event long")
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(5 * cores))
    try:
        out = oof_predictions(KaplanMeierModel, df, ["x"], 3)
        assert out.rdd.getNumPartitions() <= 3 * cores and out.count() == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
