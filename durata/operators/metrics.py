"""Censor-aware scores, keyed by any columns (model, fold, candidate, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from durata.constants import (
    BRIER_WEIGHTS,
    EVENT,
    HORIZONS,
    HYBRID_BRIER_WEIGHT,
    HYBRID_C_WEIGHT,
    PROB_COLS,
    TIME,
)
from durata.functions.columns import nn
from durata.functions.labels import horizon_label, scored_at
from durata.operators.concordance import concordance
from durata.operators.quantiles import keyed_quantiles
from durata.operators.scan import equi_depth_splits, prefix_sums, with_bucket

LOG_EPS = 2.220446049250313e-16  # fixed value: double machine epsilon
CALIBRATION_BINS = 8
MIN_CALIBRATION_ROWS = 40


def _by(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def brier_censor_aware(h: float, prob: str | None = None, boundary: str = "include") -> Column:
    """Aggregate expression; null when no row has a known status at ``h``."""
    err = F.col(prob or f"prob_{h}h") - horizon_label(h)
    return F.avg(F.when(scored_at(h, boundary=boundary), err * err))


def brier_naive(h: float) -> Column:
    err = F.col(f"prob_{h}h") - horizon_label(h)
    return F.avg(err * err)


def log_loss(h: float) -> Column:
    """Clipped log loss; null when only one class is present."""
    p = F.least(F.greatest(F.col(f"prob_{h}h"), F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    y = horizon_label(h)
    loss = F.avg(F.when(y == 1, -F.ln(p)).otherwise(-F.ln(1 - p)))
    return F.when(F.min(y) != F.max(y), loss)


def weighted(columns: dict[int, Column]) -> Column:
    return sum((F.lit(w) * columns[h] for h, w in BRIER_WEIGHTS.items()), F.lit(0.0))


def weighted_brier(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    per_h = {h: brier_censor_aware(h) for h in BRIER_WEIGHTS}
    out = _by(df, keys).agg(*[e.alias(f"brier_{h}h_ca") for h, e in per_h.items()])
    return out.withColumn(
        "weighted_brier", weighted({h: F.col(f"brier_{h}h_ca") for h in BRIER_WEIGHTS})
    )


def core_scores(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All mean-type metrics of every horizon in one aggregate."""
    keys = keys or []
    aggs = [F.count("*").alias("n")]
    aggs += [brier_censor_aware(h).alias(f"brier_{h}h_ca") for h in BRIER_WEIGHTS]
    aggs += [brier_naive(h).alias(f"brier_{h}h_naive") for h in HORIZONS]
    aggs += [log_loss(h).alias(f"logloss_{h}h") for h in HORIZONS]
    out = _by(df, keys).agg(*aggs)
    naive = sum((F.col(f"brier_{h}h_naive") for h in HORIZONS), F.lit(0.0)) / len(HORIZONS)
    return out.withColumns(
        {
            "weighted_brier": weighted({h: F.col(f"brier_{h}h_ca") for h in BRIER_WEIGHTS}),
            "brier_mean": naive,
        }
    )


def long_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per subject, key and horizon: probability and label."""
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("horizon"),
                    F.col(f"prob_{h}h").cast("double").alias("prob"),
                    horizon_label(h).alias("label"),
                )
                for h in HORIZONS
            ]
        )
    )
    return df.select(*keys, rows)


def auc(df: DataFrame, keys: list[str] | None = None, splits: list[float] | None = None) -> DataFrame:
    """ROC AUC per key and horizon, tied scores count one half; null with one class."""
    keys = keys or []
    return score_auc(long_scores(df, keys), [*keys, "horizon"], splits)


def score_auc(rows: DataFrame, by: list[str], splits: list[float] | None = None) -> DataFrame:
    """AUC of ``prob`` against ``label`` per key, from counts per distinct score.

    Buckets are cut by depth over the scores of all keys together, so none holds more than
    its share of the rows, however far apart the keys' scores lie.
    """
    if splits is None:
        splits = equi_depth_splits(rows, "prob")
    counts = rows.groupBy(*by, "prob").agg(
        F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg")
    )
    scanned = prefix_sums(with_bucket(counts, "prob", splits), by, "prob", {"below": "neg"}, inclusive=False)
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return _by(scanned, by).agg(F.when(pairs > 0, wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def calibration_curve(
    df: DataFrame, keys: list[str] | None = None, bins: int = CALIBRATION_BINS
) -> DataFrame:
    """Mean prediction and observed fraction per quantile bin, key and horizon.

    Each key and horizon has bin edges of its own; keys may be many, hot or null.
    """
    keys = keys or []
    rows = long_scores(df, keys).withColumn("known", nn("prob"))
    by = [*keys, "horizon"]
    edges = keyed_quantiles(rows, by, "known", [i / bins for i in range(bins + 1)])
    edges = edges.select(*[F.col(k).alias(f"__{k}") for k in by], "quantiles")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
    # a bin counts the inner edges strictly below the score, repeated edges included
    below = f"size(filter(slice(quantiles, 2, {bins - 1}), e -> prob > e))"
    binned = rows.join(edges, same, "left").withColumn("bin", F.expr(f"if(prob is null, null, {below})"))
    return binned.groupBy(*by, "bin").agg(
        F.count("*").alias("n"),
        F.avg("prob").alias("mean_pred"),
        F.avg(F.col("label").cast("double")).alias("frac_pos"),
    )


def calibration_gap(curve: DataFrame, keys: list[str] | None = None, horizon: int = 72) -> DataFrame:
    """Mean absolute gap over the bins; needs both classes and at least 40 rows."""
    keys = keys or []
    at_h = curve.filter(F.col("horizon") == horizon)
    gap = F.avg(F.abs(F.col("frac_pos") - F.col("mean_pred")))
    mixed = (F.max("frac_pos") > 0) & (F.min("frac_pos") < 1)
    enough = F.sum("n") >= MIN_CALIBRATION_ROWS
    return _by(at_h, keys).agg(F.when(mixed & enough, gap).alias(f"calibration_gap_{horizon}h"))


def hybrid(c_index: Column, brier: Column) -> Column:
    return HYBRID_C_WEIGHT * c_index + HYBRID_BRIER_WEIGHT * (1.0 - brier)


def _join_keyed(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Side by side; without keys every frame is a single row."""
    if keys:
        return reduce(lambda a, b: a.join(b, keys, "left"), frames)
    tagged = [f.withColumn("__one", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(b, "__one", "left"), tagged).drop("__one")


def hybrid_score(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hybrid score with its components."""
    keys = keys or []
    c = concordance(df, keys).select(*keys, "c_index")
    out = _join_keyed([weighted_brier(df, keys), c], keys)
    return out.withColumn("hybrid_score", hybrid(F.col("c_index"), F.col("weighted_brier")))


def all_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every metric, one row per key. ``df`` is read several times: persist it if it is
    expensive; only key, target and probability columns are used."""
    keys = keys or []
    slim = df.select(*keys, TIME, EVENT, *PROB_COLS)
    wide_auc = _by(auc(slim, keys), keys).agg(
        *[F.max(F.when(F.col("horizon") == h, F.col("auc"))).alias(f"auc_{h}h") for h in HORIZONS]
    )
    frames = [
        core_scores(slim, keys),
        concordance(slim, keys).select(*keys, "c_index"),
        wide_auc,
        calibration_gap(calibration_curve(slim, keys), keys),
    ]
    out = _join_keyed(frames, keys)
    return out.withColumn("hybrid_score", hybrid(F.col("c_index"), F.col("weighted_brier")))


def hard_prediction(prob: str = "prob_72h") -> Column:
    return (F.col(prob) >= 0.5).cast("int")


def fold_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population std per metric over folds; missing values are skipped."""
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count("value").alias("folds"),
    )
