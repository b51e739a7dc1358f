"""Error analysis of predictions joined to the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import EVENT, HORIZONS, ID, TIME
from durata.functions.columns import nn
from durata.functions.labels import horizon_label
from durata.operators.quality import _sql_value
from durata.operators.quantiles import exact_quantiles
from durata.operators.stats import band_rates


def per_sample_errors(df: DataFrame) -> DataFrame:
    """Mean squared error over the horizons, and the absolute error at 72 h, per row."""
    squares = [(F.col(f"prob_{h}h") - horizon_label(h)) ** 2 for h in HORIZONS]
    return df.withColumns(
        {
            "brier_sample": sum(squares[1:], squares[0]) / len(HORIZONS),
            "label_72h": horizon_label(72),
            "abs_err_72h": F.abs(F.col("prob_72h") - horizon_label(72)),
        }
    )


def error_summary(errors: DataFrame) -> DataFrame:
    median = exact_quantiles(errors, {"b": nn("brier_sample")}, [0.5])["b"][0]
    return errors.agg(
        F.avg("brier_sample").alias("mean"), F.max("brier_sample").alias("max")
    ).withColumn("median", F.lit(median))


def worst_k(errors: DataFrame, k: int = 15, columns: list[str] | None = None) -> DataFrame:
    """Top-k report by loss; each task keeps its own k before the final merge."""
    chosen = columns or [ID, "brier_sample", EVENT, TIME, "prob_72h"]
    return errors.orderBy(F.col("brier_sample").desc(), F.col(ID).asc()).limit(k).select(*chosen)


def worst_decile_profile(errors: DataFrame, features: list[str], q: float = 0.90) -> DataFrame:
    """Feature means of the worst decile against the rest, by standardised difference."""
    cut = exact_quantiles(errors, {"b": nn("brier_sample")}, [q])["b"][0]
    worst = f"brier_sample >= {float(cut)!r}D"
    aggs = []
    for i, c in enumerate(features):
        v = _sql_value(c)
        aggs += [
            f"avg(case when {worst} then {v} end) as w{i}",
            f"avg(case when not {worst} then {v} end) as r{i}",
            f"stddev_samp(case when not {worst} then {v} end) as s{i}",
        ]
    rows = ", ".join(
        f"named_struct('feature','{c}','worst_mean',w{i},'rest_mean',r{i},"
        f"'abs_diff',abs(w{i} - r{i}),'std_diff',(w{i} - r{i}) / nullif(s{i}, 0D))"
        for i, c in enumerate(features)
    )
    out = errors.selectExpr(*aggs).selectExpr(f"inline(array({rows}))")
    return out.orderBy(F.abs("std_diff").desc_nulls_last(), "feature")


def error_by_band(errors: DataFrame, column: str = "dist_min_ci_0_5h", q: int = 4) -> DataFrame:
    return band_rates(errors, column, q, error="brier_sample")


def error_by_time(errors: DataFrame) -> DataFrame:
    """Mean error by start hour and by start month from one grouping-sets aggregate."""
    hour, month = "event_start_hour", "event_start_month"
    out = errors.groupingSets([[hour], [month]], hour, month).agg(
        F.grouping(hour).alias("__no_hour"),
        F.avg("brier_sample").alias("mean_error"),
        F.count("*").alias("n"),
        F.avg(F.col(EVENT).cast("double")).alias("hit_rate"),
    )
    by_hour = F.col("__no_hour") == 0
    return out.select(
        F.when(by_hour, "hour").otherwise("month").alias("unit"),
        F.when(by_hour, F.col(hour)).otherwise(F.col(month)).alias("value"),
        "mean_error", "n", "hit_rate",
    )


def false_negatives(errors: DataFrame, below: float = 0.3) -> DataFrame:
    return errors.filter((F.col("label_72h") == 1) & (F.col("prob_72h") < below))


def false_positives(errors: DataFrame, above: float = 0.7) -> DataFrame:
    return errors.filter((F.col("label_72h") == 0) & (F.col("prob_72h") > above))


def join_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with their duration and event flag, matched on the id."""
    return predictions.join(truth.select(ID, TIME, EVENT), ID)
