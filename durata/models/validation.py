"""Cross-validation, out-of-fold predictions and hyper-parameter search.

Rows are tagged with their fold once and persisted; all folds of a model are fitted
(sharing jobs where the model can) and every fold is scored in one keyed metrics job.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import EVENT, ID, PROB_COLS, SEARCH_SPACES, TIME
from durata.models.base import FIT_THREADS, HorizonModel, ModelFactory, default_features
from durata.models.trees import pass_partitions
from durata.operators.metrics import all_metrics, fold_summary, hybrid_score
from durata.operators.resample import stratified_folds, stratified_holdout
from durata.session import cut_lineage
from durata.sources.tables import metrics_to_long

KEY_METRICS = ("hybrid_score", "weighted_brier", "c_index")


def _slim(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*dict.fromkeys([ID, TIME, EVENT, *features]))


def _tagged(df: DataFrame, features: list[str], k: int, seed: int) -> DataFrame:
    """Slim rows with their fold, persisted in a partition a core: every fold's pass reads them all."""
    return stratified_folds(_slim(df, features), k, seed).coalesce(pass_partitions(df)).persist()


def _fill_missing(preds: DataFrame) -> DataFrame:
    """A probability a model could not give counts as one half."""
    return preds.withColumns({c: F.coalesce(F.nanvl(c, F.lit(None)), F.lit(0.5)) for c in PROB_COLS})


def predict_folds(models: dict[int, HorizonModel], tagged: DataFrame, extra: list[str]) -> DataFrame:
    keep = [ID, TIME, EVENT, "fold", *extra, *PROB_COLS]
    parts = [m.predict(tagged.filter(F.col("fold") == f)).select(*keep) for f, m in models.items()]
    return _fill_missing(reduce(DataFrame.unionByName, parts))


def oof_predictions(
    factory: ModelFactory, df: DataFrame, features: list[str] | None = None, k: int = 5, seed: int = 42
) -> DataFrame:
    """Every subject predicted by the model that did not see its fold."""
    features = default_features(df, features)
    tagged = _tagged(df, features, k, seed)
    models = factory().fit_folds(tagged, features, list(range(k)), "fold")
    return predict_folds(models, tagged, [])


def cross_validate(
    factory: ModelFactory,
    df: DataFrame,
    features: list[str] | None = None,
    k: int = 5,
    seed: int = 42,
    model: str = "model",
) -> DataFrame:
    """(model, metric, mean, std, folds) over the folds."""
    oof = cut_lineage(oof_predictions(factory, df, features, k, seed))
    scores = all_metrics(oof, ["fold"]).drop("n")
    tall = metrics_to_long(scores, ["fold"]).withColumn("model", F.lit(model))
    return fold_summary(tall, ["model"])


def repeated_cv(
    factory: ModelFactory,
    df: DataFrame,
    features: list[str] | None = None,
    k: int = 5,
    repeats: int = 10,
    base_seed: int = 42,
) -> DataFrame:
    """Fold scores of every repeat (repeat, fold, hybrid_score, weighted_brier, c_index)."""
    parts = [
        oof_predictions(factory, df, features, k, base_seed + r).withColumn("repeat", F.lit(r))
        for r in range(repeats)
    ]
    oof = cut_lineage(reduce(DataFrame.unionByName, parts))
    return hybrid_score(oof, ["repeat", "fold"]).select("repeat", "fold", *KEY_METRICS)


def repeated_cv_summary(scores: DataFrame) -> DataFrame:
    aggs = [F.count("*").alias("n_evaluations")]
    for m in KEY_METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return scores.agg(*aggs)


def holdout_predictions(
    factory: ModelFactory,
    df: DataFrame,
    features: list[str] | None = None,
    fraction: float = 0.25,
    seed: int = 42,
) -> DataFrame:
    """Fit on the larger part of a stratified split, predict the held-out part."""
    features = default_features(df, features)
    split = stratified_holdout(_slim(df, features), fraction, seed).persist()
    model = factory().fit(split.filter(~F.col("holdout")), features)
    out = model.predict(split.filter("holdout")).select(ID, TIME, EVENT, *PROB_COLS)
    return _fill_missing(out)


def refit_and_predict(
    factory: ModelFactory, train: DataFrame, test: DataFrame, features: list[str] | None = None
) -> tuple[HorizonModel, DataFrame]:
    features = default_features(train, features)
    model = factory().fit(train, features)
    return model, model.predict(test).select(ID, *PROB_COLS)


def sample_params(space: dict[str, tuple[str, float, float]], rng: np.random.Generator) -> dict[str, Any]:
    """One draw: integers inclusive, floats uniform, ``log`` log-uniform."""
    out: dict[str, Any] = {}
    for name, (kind, lo, hi) in space.items():
        if kind == "int":
            out[name] = int(rng.integers(int(lo), int(hi) + 1))
        elif kind == "log":
            out[name] = float(math.exp(rng.uniform(math.log(lo), math.log(hi))))
        else:
            out[name] = float(rng.uniform(lo, hi))
    return out


def cv_hybrid(factory: ModelFactory, tagged: DataFrame, features: list[str], k: int) -> float:
    """Mean hybrid score over the folds of rows that are tagged with them."""
    models = factory().fit_folds(tagged, features, list(range(k)), "fold")
    oof = predict_folds(models, tagged, [])
    row = hybrid_score(cut_lineage(oof), ["fold"]).agg(F.avg("hybrid_score")).first()
    return float(row[0])


def tune(
    build: Callable[..., HorizonModel],
    df: DataFrame,
    space: dict[str, tuple[str, float, float]] | str,
    features: list[str] | None = None,
    n_trials: int = 50,
    timeout_s: float | None = None,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Seeded random search maximising the mean cross-validated hybrid score.

    A few trials run at a time; the time limit is looked at between such groups. All have the
    same folds, so rows are tagged once.

    A trial that raises is kept with its error and no value. One row per trial;
    ``stopped_early`` tells whether ``timeout_s`` ended the search before ``n_trials``.
    """
    space = SEARCH_SPACES[space] if isinstance(space, str) else space
    features = default_features(df, features)
    tagged = _tagged(df, features, k, seed)
    rng = np.random.default_rng(seed)
    trials, began = [], time.monotonic()

    def run(i: int, params: dict[str, Any]) -> tuple:
        start = time.monotonic()
        try:
            value, error = cv_hybrid(lambda: build(**params, seed=seed), tagged, features, k), None
        except Exception as e:  # noqa: BLE001 - a failed trial is a result
            value, error = None, str(e)
        return i, json.dumps(params, sort_keys=True), value, error, time.monotonic() - start

    with ThreadPoolExecutor(FIT_THREADS) as pool:
        # draws are made in order, so results do not depend on which trial ends first
        while len(trials) < n_trials:
            if trials and timeout_s is not None and time.monotonic() - began > timeout_s:
                break
            first = len(trials)
            drawn = [sample_params(space, rng) for _ in range(min(FIT_THREADS, n_trials - first))]
            trials += pool.map(run, range(first, first + len(drawn)), drawn)
    tagged.unpersist()
    schema = "trial int, params string, value double, error string, seconds double"
    out = df.sparkSession.createDataFrame(trials, schema)
    return out.withColumn("stopped_early", F.lit(len(trials) < n_trials))


def best_trial(trials: DataFrame) -> tuple[dict[str, Any], float] | None:
    row = trials.filter("error is null").agg(F.max_by(F.struct("params", "value"), "value")).first()[0]
    return None if row is None else (json.loads(row["params"]), row["value"])


def nested_cv(
    build: Callable[..., HorizonModel],
    df: DataFrame,
    space: dict[str, tuple[str, float, float]] | str,
    features: list[str] | None = None,
    n_outer: int = 5,
    n_inner: int = 5,
    n_trials: int = 30,
    seed: int = 42,
) -> DataFrame:
    """Held-out hybrid score per outer fold, with parameters tuned inside the other folds.

    A fold whose trials or refit failed keeps its row, with the error and no score.
    """
    features = default_features(df, features)
    tagged = _tagged(df, features, n_outer, seed)
    results = []
    for f in range(n_outer):
        inner = tagged.filter(F.col("fold") != f).drop("fold")
        trials = cut_lineage(tune(build, inner, space, features, n_trials, None, n_inner, seed))
        best = best_trial(trials)
        if best is None:
            error = trials.agg(F.min_by("error", "trial")).first()[0]
            results.append((f, None, None, None, error))
            continue
        params, inner_value = best
        text = json.dumps(params, sort_keys=True)
        try:
            model = build(**params, seed=seed).fit(inner, features)
            preds = model.predict(tagged.filter(F.col("fold") == f)).select(ID, TIME, EVENT, *PROB_COLS)
            held_out, error = hybrid_score(cut_lineage(preds)).first()["hybrid_score"], None
        except Exception as e:  # noqa: BLE001 - a failed fold is a result
            held_out, error = None, str(e)
        results.append((f, held_out, inner_value, text, error))
    tagged.unpersist()
    schema = "fold int, held_out_hybrid double, inner_best_hybrid double, best_params string, error string"
    return df.sparkSession.createDataFrame(results, schema)


def nested_summary(folds: DataFrame) -> DataFrame:
    """Mean and spread of the held-out score, how optimistic tuning was, and failed folds."""
    gap = F.col("inner_best_hybrid") - F.col("held_out_hybrid")
    return folds.agg(
        F.count("held_out_hybrid").alias("folds"), F.count("error").alias("failed"),
        F.avg("held_out_hybrid").alias("mean_hybrid"), F.stddev_pop("held_out_hybrid").alias("std_hybrid"),
        F.avg(gap).alias("mean_optimism"),
    )
