import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from durata.constants import PROB_COLS, SEARCH_SPACES
from durata.models.aft import lognormal_model, normal_upper, weibull_model
from durata.models.boosting import (
    BoostedHorizons,
    BoostedSurvival,
    leaf_wise_model,
    level_wise_model,
    monotone_vector,
    symmetric_model,
)
from durata.models.classifiers import logistic_model
from durata.models.cox import CoxModel
from durata.models.forest import SurvivalForest
from durata.models.importance import permutation_importance, recursive_elimination, shift_verdict
from durata.models.marginal import KaplanMeierModel
from durata.models.persist import load_model, save_model
from durata.models.seeds import SeedEnsemble
from durata.models.stacking import IsotonicCalibrator, MetaLearner
from durata.models.validation import best_trial, oof_predictions, repeated_cv, sample_params, tune
from durata.operators.ensemble import (
    check_members,
    normalized_weights,
    optimize_weights,
    simplex_grid,
    weighted_average,
)
from durata.operators.metrics import core_scores

FEATURES = ["dist_min_ci_0_5h", "closing_speed_m_per_h", "noise"]


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(0)
    rows = []
    for i in range(400):
        dist, speed, noise = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        t = rng.expovariate(math.exp(-3.4 - 1.2 * dist + 0.8 * speed))
        c = rng.uniform(10, 100)
        e = int(t <= min(c, 72.0))
        rows.append((i, dist, speed, noise if i % 20 else None, float(math.ceil(min(t, c, 72.0))), e))
    cols = "event_id long, dist_min_ci_0_5h double, closing_speed_m_per_h double, noise double, time_to_hit_hours double, event long"
    return spark.createDataFrame(rows, cols).persist()


def brier(model, df):
    return core_scores(model.predict(df)).first()["brier_mean"]


MODELS = {
    "cox": lambda: CoxModel(0.01),
    "weibull": weibull_model,
    "lognormal": lognormal_model,
    "logistic": logistic_model,
    "boosted": lambda: BoostedHorizons(n_estimators=6, max_depth=3, learning_rate=0.3),
    "leaf": lambda: leaf_wise_model(n_estimators=5, max_leaves=6, learning_rate=0.3),
    "symmetric": lambda: symmetric_model(n_estimators=6, max_depth=3, learning_rate=0.3),
    "survival_boost": lambda: BoostedSurvival(n_estimators=8, learning_rate=0.3),
    "survival_forest": lambda: SurvivalForest(n_estimators=8, max_depth=4),
}


@pytest.mark.parametrize("name", list(MODELS))
def test_models_beat_the_marginal_curve(train, name):
    model = MODELS[name]().fit(train, FEATURES)
    rows = model.predict(train).select("event_id", *PROB_COLS).collect()
    assert len(rows) == 400
    for r in rows:
        p = r[1:]
        assert all(0 <= v <= 1 for v in p) and list(p) == sorted(p)
    assert brier(model, train) < 0.9 * brier(KaplanMeierModel().fit(train), train)


@pytest.mark.parametrize("name", ["cox", "weibull", "survival_boost", "survival_forest", "boosted", "logistic"])
def test_saved_model_predicts_the_same(spark, train, name):
    model = MODELS[name]().fit(train, FEATURES)
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    save_model(spark, model, path)
    again = load_model(spark, path)
    a = {r[0]: r[1] for r in model.predict(train).select("event_id", "prob_48h").collect()}
    b = {r[0]: r[1] for r in again.predict(train).select("event_id", "prob_48h").collect()}
    assert a == pytest.approx(b)


def efron(rows, beta):
    """Penalty-free log partial likelihood and gradient by the textbook double sum."""
    ll, grad = 0.0, np.zeros(len(beta))
    for t in sorted({r[-2] for r in rows if r[-1] == 1}):
        risk = np.array([r[:-2] for r in rows if r[-2] >= t])
        dead = np.array([r[:-2] for r in rows if r[-2] == t and r[-1] == 1])
        w, wd = np.exp(risk @ beta), np.exp(dead @ beta)
        ll += float((dead @ beta).sum())
        grad += dead.sum(axis=0)
        for k in range(len(dead)):
            f = k / len(dead)
            s0 = w.sum() - f * wd.sum()
            ll -= math.log(s0)
            grad -= (w @ risk - f * (wd @ dead)) / s0
    return ll, grad


def test_cox_optimum_and_efron_ties(train):
    model = CoxModel(0.05, tol=1e-8).fit(train, FEATURES)
    assert model.gradient_norm < 1e-6
    med, mean, scale = model.medians, np.array(model.mean), np.array(model.scale)
    rows = []
    for r in train.collect():
        x = [r[c] if r[c] is not None else med[c] for c in FEATURES]
        rows.append((*((np.array(x) - mean) / scale), r["time_to_hit_hours"], r["event"]))
    beta = np.array(model.coef)
    ll, grad = efron(rows, beta)  # whole-hour times: many tied hits
    assert model.log_likelihood == pytest.approx(ll, rel=1e-9)
    assert grad / len(rows) == pytest.approx(0.05 * beta, abs=1e-6)
    assert beta[0] < -0.5 and beta[1] > 0.3


def test_normal_tail_accuracy():
    w = np.array([-40.0, -8.0, -3.0, -0.5, 0.0, 0.7, 3.5355339, 3.6, 8.0, 30.0])
    log_sf, hazard = normal_upper(w)
    for x, ls, h in zip(w, log_sf, hazard, strict=True):
        tail = 0.5 * math.erfc(x / math.sqrt(2))
        assert ls == pytest.approx(math.log(tail), rel=1e-12, abs=1e-15)
        pdf = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        assert h == pytest.approx(pdf / tail, rel=1e-9)


def test_weibull_recovers_exponential(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        x = rng.gauss(0, 1)
        t = rng.expovariate(math.exp(-3 + 0.7 * x))
        rows.append((i, x, min(t, 72.0), int(t <= 72)))
    df = spark.createDataFrame(rows, "event_id long, x double, time_to_hit_hours double, event long")
    m = weibull_model(0.0).fit(df, ["x"])
    assert m.gradient_norm < 1e-6
    assert m.params[0] == pytest.approx(3, abs=0.1) and math.exp(m.params[-1]) == pytest.approx(1, abs=0.06)
    assert m.params[1] / m.scale[0] == pytest.approx(-0.7, abs=0.06)


def test_monotone_constraints_hold_on_a_grid(spark, train):
    assert monotone_vector(["dist_min_ci_0_5h", "unknown", "closing_speed_m_per_h"]) == [-1, 0, 1]
    assert monotone_vector(["unknown"], {"unknown": 1}) == [1]
    model = BoostedHorizons(n_estimators=10, max_depth=4, learning_rate=0.3, monotone=True).fit(train, FEATURES)
    grid = spark.range(60).selectExpr(
        "id as event_id", "(id - 30) / 10.0D as dist_min_ci_0_5h", "0.1D as closing_speed_m_per_h", "0.0D as noise"
    )
    for h in PROB_COLS:
        p = [r[0] for r in model.predict(grid).orderBy("event_id").select(h).collect()]
        assert all(b <= a + 1e-12 for a, b in zip(p, p[1:], strict=False))


def test_search_spaces_fit_their_models():
    rng = np.random.default_rng(0)
    builders = {
        "gradient_boosted_survival": BoostedSurvival, "random_survival_forest": SurvivalForest,
        "xgboost": level_wise_model,
    }
    for name, space in SEARCH_SPACES.items():
        params = sample_params(space, rng)
        model = builders[name](**params, seed=7)
        assert model.seed == 7 and model.n_estimators == params["n_estimators"]
    with pytest.warns(UserWarning, match="objective"):
        assert level_wise_model(objective="x", colsample_bytree=0.5).colsample == 0.5


def test_fold_models_do_not_see_their_fold(train):
    oof = oof_predictions(MODELS["survival_boost"], train, FEATURES, 3)
    assert oof.count() == 400 and oof.select("fold").distinct().count() == 3
    alone = MODELS["survival_boost"]().fit
    tagged = oof.select("event_id", "fold")
    rest = train.join(tagged, "event_id")
    model = alone(rest.filter("fold <> 0"), FEATURES)
    # bin edges come from all folds when folds share jobs, so predictions agree closely, not exactly
    a = {r[0]: r[1] for r in oof.filter("fold = 0").select("event_id", "prob_48h").collect()}
    b = {r[0]: r[1] for r in model.predict(rest.filter("fold = 0")).select("event_id", "prob_48h").collect()}
    assert np.mean([abs(a[i] - b[i]) for i in a]) < 0.08


def test_seed_ensemble_averages(train):
    ens = SeedEnsemble(lambda s: SurvivalForest(n_estimators=3, max_depth=3, seed=s), (1, 2)).fit(train, FEATURES)
    parts = [m.predict(train).orderBy("event_id").select("prob_24h").collect() for m in ens.models]
    both = ens.predict(train).orderBy("event_id").select("prob_24h").collect()
    for a, b, c in zip(*parts, both, strict=True):
        assert c[0] == pytest.approx((a[0] + b[0]) / 2)


def test_repeated_cv_counts_and_tuning(train):
    assert repeated_cv(KaplanMeierModel, train, FEATURES, k=3, repeats=2).count() == 6
    space = {"n_estimators": ("int", 2, 4), "max_depth": ("int", 1, 3)}
    trials = tune(SurvivalForest, train, space, FEATURES, n_trials=2, k=2)
    params, value = best_trial(trials)
    assert 2 <= params["n_estimators"] <= 4 and 0 < value < 1
    broken = tune(lambda **kw: 1 / 0, train, space, FEATURES, n_trials=2, k=2)
    assert broken.filter("error is not null").count() == 2 and best_trial(broken) is None


def long_members(spark, spec):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        e, t = int(rng.random() < 0.6), rng.uniform(1, 72)
        truth = [int(e and t <= h) for h in (12, 24, 48, 72)]
        for name, noise in spec.items():
            p = sorted(min(max(v * (1 - noise) + rng.random() * noise, 0), 1) for v in truth)
            rows.append((i, name, t, e, *p))
    cols = "event_id long, model string, time_to_hit_hours double, event long, " + ", ".join(f"{c} double" for c in PROB_COLS)
    return spark.createDataFrame(rows, cols)


def test_weight_rules(spark):
    with pytest.raises(ValueError, match="non-negative"):
        normalized_weights({"a": -1.0, "b": 2.0})
    with pytest.raises(ValueError, match="positive value"):
        normalized_weights({"a": 0.0})
    with pytest.raises(ValueError, match="no predictions"):
        normalized_weights({})
    assert normalized_weights({"a": 3.0, "b": 1.0}) == {"a": 0.75, "b": 0.25}
    preds = long_members(spark, {"a": 0.1, "b": 0.9})
    weighted_average(preds, {"a": 1.0, "b": 1.0}, validate=True)
    with pytest.raises(ValueError, match="ids"):
        check_members(preds.filter("not (model = 'b' and event_id = 3)"), ["a", "b"])


def test_weight_search_prefers_the_better_member(spark):
    assert len(simplex_grid(3, 4)) == 15
    preds = long_members(spark, {"good": 0.2, "bad": 1.0})
    for objective in ("hybrid", "brier"):
        w = optimize_weights(preds, ["good", "bad"], objective, rounds=2)
        assert sum(w.values()) == pytest.approx(1) and w["good"] > w["bad"]
    assert optimize_weights(preds, ["good"]) == {"good": 1.0}
    with pytest.raises(ValueError, match="Unknown objective"):
        optimize_weights(preds, ["good", "bad"], "other")


def test_stacking_and_wrong_members(spark):
    preds = long_members(spark, {"a": 0.3, "b": 0.8})
    meta = MetaLearner().fit(preds, ["a", "b"])
    rows = meta.predict(preds).collect()
    assert len(rows) == 120 and all(list(r[1:]) == sorted(r[1:]) for r in rows)
    with pytest.raises(ValueError, match="expected 2 models"):
        meta.predict(preds.filter("model = 'a'"))


def test_isotonic_calibration(spark):
    preds = long_members(spark, {"a": 0.9}).drop("model")
    cal = IsotonicCalibrator().fit(preds)
    out = cal.transform(preds)
    assert set(cal.summary().values()) == {"fitted"}
    before, after = core_scores(preds).first(), core_scores(out).first()
    assert after["weighted_brier"] <= before["weighted_brier"]
    none = IsotonicCalibrator(min_events=10**6).fit(preds)
    assert set(none.summary().values()) == {"skipped"}
    with pytest.raises(RuntimeError):
        IsotonicCalibrator().transform(preds)


def test_importance_finds_the_signal(train):
    ranked = permutation_importance(train, FEATURES, n_repeats=2, trees=10, max_depth=5)
    order = [r["feature"] for r in ranked.collect()]
    assert order[-1] == "noise"
    assert "noise" not in recursive_elimination(train, FEATURES, keep=2, step=1, trees=10, max_depth=5)
    assert recursive_elimination(train, FEATURES, keep=5) == FEATURES
    assert [shift_verdict(v) for v in (0.5, 0.6, 0.8)] == ["no meaningful shift", "mild shift", "significant shift"]


def test_predictions_work_on_a_stream(spark, train):
    from durata.streaming.scoring import score_stream

    model = weibull_model().fit(train, FEATURES)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    train.write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(train.schema).parquet(f"{folder}/in")
    q = score_stream(model, stream, f"{folder}/out", f"{folder}/check")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == 400
    diff = got.join(model.predict(train).select("event_id", F.col("prob_72h").alias("q")), "event_id")
    assert diff.agg(F.max(F.abs(F.col("prob_72h") - F.col("q")))).first()[0] < 1e-12


@pytest.mark.parametrize("ratio", [0.0, 0.5, 1.0])
def test_cox_penalty_mix_and_evaluations(train, ratio):
    model = CoxModel(0.08, tol=1e-9, l1_ratio=ratio).fit(train, FEATURES)
    assert model.evaluations <= 8
    med, mean, scale = model.medians, np.array(model.mean), np.array(model.scale)
    rows = []
    for r in train.collect():
        x = [r[c] if r[c] is not None else med[c] for c in FEATURES]
        rows.append((*((np.array(x) - mean) / scale), r["time_to_hit_hours"], r["event"]))
    beta = np.array(model.coef)
    slope = efron(rows, beta)[1] / len(rows) - 0.08 * (1 - ratio) * beta
    for b, g in zip(beta, slope, strict=True):
        if b:
            assert g == pytest.approx(0.08 * ratio * np.sign(b), abs=1e-6)
        else:
            assert abs(g) <= 0.08 * ratio + 1e-9
    assert (beta == 0).any() == (ratio > 0)  # the noise feature goes


def test_cox_with_one_hot_time(spark):
    """Half of all rows, hits among them, share one time that spans several partitions."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        t = 30.0 if i % 2 else float(rng.randrange(1, 70))
        rows.append((i, a, b, t, int(rng.random() < 1 / (1 + math.exp(-a)))))
    df = spark.createDataFrame(rows, "event_id long, a double, b double, time_to_hit_hours double, event long")
    model = CoxModel(0.01, tol=1e-9).fit(df, ["a", "b"])
    z = np.array([r[1:3] for r in rows])
    z = (z - np.array(model.mean)) / np.array(model.scale)
    ll, grad = efron([(*x, r[3], r[4]) for x, r in zip(z, rows, strict=True)], np.array(model.coef))
    assert model.log_likelihood == pytest.approx(ll, rel=1e-10)
    assert grad / len(rows) == pytest.approx(0.01 * np.array(model.coef), abs=1e-8)
    # Breslow hazard by the double sum
    t, e, r = np.array([x[3] for x in rows]), np.array([x[4] for x in rows]), np.exp(z @ np.array(model.coef))
    for h, got in zip((12, 24, 48, 72), model.hazard, strict=True):
        assert got == pytest.approx(sum(1 / r[t >= s].sum() for s, d in zip(t, e, strict=True) if d and s <= h))


@pytest.mark.parametrize("make", [weibull_model, lognormal_model])
def test_aft_l1_ratio(train, make):
    """Optimum conditions from the ridge fit's own gradient; the noise feature goes."""
    model = make(0.1, 1.0)
    model.tol = 1e-9
    model.fit(train, FEATURES)
    assert model.gradient_norm < 1e-8
    assert model.params[3] == 0 and model.params[1] != 0
    ridge = make(0.1).fit(train, FEATURES)
    assert ridge.params[3] != 0 and ridge.evaluations <= 15


def test_isotonic_is_exact_over_partitions(spark):
    """Min-max formula of isotonic regression, at every distinct score."""
    rng = random.Random(8)
    data = [(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(700)]
    df = spark.createDataFrame(data, "score double, y int").repartition(6)
    from durata.models.stacking import isotonic_knots

    x, y = isotonic_knots(df)
    scores = sorted({s for s, _ in data})
    total = np.array([sum(v for s, v in data if s == u) for u in scores])
    count = np.array([sum(s == u for s, _ in data) for u in scores])
    for i, u in enumerate(scores):
        want = max(min(total[a : b + 1].sum() / count[a : b + 1].sum() for b in range(i, len(scores))) for a in range(i + 1))
        assert np.interp(u, x, y) == pytest.approx(want)
    assert list(x) == sorted(x) and list(y) == sorted(y)


def test_tree_models_are_saved_node_by_node(spark, train, monkeypatch):
    from durata.models import persist

    monkeypatch.setattr(persist, "NODE_ROWS", 50)
    model = SeedEnsemble(lambda s: SurvivalForest(n_estimators=3, seed=s), seeds=(1, 2)).fit(train, FEATURES)
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    save_model(spark, model, path)
    nodes = spark.read.parquet(f"{path}/nodes")
    assert nodes.count() == sum(len(t.feature) for m in model.models for t in m.trees)
    assert nodes.select("path").distinct().count() == 2
    again = load_model(spark, path)
    a, b = (sorted(map(tuple, m.predict(train).select("event_id", *PROB_COLS).collect())) for m in (model, again))
    assert np.allclose(a, b)


def test_nested_folds_keep_their_failures(train):
    from durata.models.validation import nested_cv, nested_summary

    space = {"n_estimators": ("int", 2, 3)}
    good = nested_cv(SurvivalForest, train, space, FEATURES, 2, 2, 2)
    row = nested_summary(good).first()
    scores = [r["held_out_hybrid"] for r in good.collect()]
    assert (row["folds"], row["failed"]) == (2, 0) and row["mean_hybrid"] == pytest.approx(np.mean(scores))

    def broken(**kw):
        raise ValueError("no such model")

    bad = nested_cv(broken, train, space, FEATURES, 2, 2, 2)
    assert [r["error"] for r in bad.collect()] == ["no such model"] * 2
    assert nested_summary(bad).first()["failed"] == 2
