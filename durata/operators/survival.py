"""Kaplan-Meier, Nelson-Aalen and log-rank as keyed aggregates and ordered scans."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from durata.constants import EVENT, HORIZONS, PROB_COLS, TIME
from durata.functions.columns import nn, significance_stars
from durata.operators.quantiles import exact_quantiles
from durata.operators.scan import equi_depth_splits, prefix_sums, with_bucket

Z95 = 1.959963984540054  # fixed value: two-sided 95 % normal quantile


def risk_table(
    df: DataFrame,
    keys: list[str] | None = None,
    splits: list[float] | None = None,
    time: str = TIME,
    event: str = EVENT,
) -> DataFrame:
    """One row per (keys, distinct time): hits ``d``, censored ``c``, at risk ``n``."""
    keys = keys or []
    if splits is None:
        splits = equi_depth_splits(df, time)
    counted = (
        df.select(*keys, F.col(time).cast("double").alias("time"), F.col(event).alias("__e"))
        .groupBy(*keys, "time")
        .agg(F.count_if(F.col("__e") == 1).alias("d"), F.count_if(F.col("__e") == 0).alias("c"))
    )
    bucketed = with_bucket(counted, "time", splits)
    return prefix_sums(bucketed, keys, "time", {"n": F.col("d") + F.col("c")}, reverse=True)


def _log_step() -> Column:
    """log(1 - d/n); null at the last time where everyone left was hit (S = 0 there)."""
    return F.when(F.col("d") < F.col("n"), F.log1p(-(F.col("d") / F.col("n"))))


def km_curve(df: DataFrame, keys: list[str] | None = None, splits: list[float] | None = None) -> DataFrame:
    """Survival and cumulative hazard with 95 % bands (log-log, log) at every distinct time.

    The hazard is the plain sum of d/n; tied hits are not spread out.
    """
    keys = keys or []
    d, n = F.col("d"), F.col("n")
    table = risk_table(df, keys, splits)
    scanned = prefix_sums(
        table,
        keys,
        "time",
        {
            "log_s": _log_step(),
            "v": F.when(d < n, d / (n * (n - d))),
            "hazard": d / n,
            "hazard_var": d / (n * n),
        },
    )
    log_s, dead = F.col("log_s"), d == n
    half = F.try_divide(F.lit(Z95) * F.sqrt("v"), F.abs(log_s))
    band = {
        "survival_lower": F.exp(-F.exp(F.ln(-log_s) + half)),
        "survival_upper": F.exp(-F.exp(F.ln(-log_s) - half)),
    }
    inside = ~dead & (log_s < 0)
    spread = F.try_divide(F.lit(Z95) * F.sqrt("hazard_var"), F.nullif("hazard", F.lit(0.0)))
    hazard_band = {
        "hazard_lower": F.col("hazard") * F.exp(-spread),
        "hazard_upper": F.col("hazard") * F.exp(spread),
    }
    return scanned.withColumns(
        {
            "survival": F.when(dead, F.lit(0.0)).otherwise(F.exp(log_s)),
            **{name: F.when(inside, e) for name, e in band.items()},
            **hazard_band,
        }
    ).select(
        *keys, "time", "n", "d", "c", "survival", "survival_lower", "survival_upper",
        "hazard", "hazard_var", "hazard_lower", "hazard_upper",
    )


def km_horizons(
    df: DataFrame,
    keys: list[str] | None = None,
    horizons: tuple[float, ...] = HORIZONS,
    splits: list[float] | None = None,
) -> DataFrame:
    """P(hit by h) per key: one scan for the risk sets, then a plain aggregate."""
    keys = keys or []
    table = risk_table(df, keys, splits)
    aggs = []
    for h in horizons:
        by_h = F.col("time") <= F.lit(float(h))
        log_s = F.coalesce(F.sum(F.when(by_h, _log_step())), F.lit(0.0))
        extinct = F.coalesce(F.bool_or(by_h & (F.col("d") == F.col("n"))), F.lit(False))
        aggs.append(F.when(extinct, F.lit(1.0)).otherwise(1 - F.exp(log_s)).alias(f"prob_{h}h"))
    subjects = F.sum(F.col("d") + F.col("c")).alias("n")
    out = table.groupBy(*keys) if keys else table.groupBy()
    return out.agg(subjects, F.sum("d").alias("hits"), *aggs)


def step_on_grid(
    df: DataFrame,
    keys: list[str] | None = None,
    points: int = 200,
    end: float = 72.0,
    splits: list[float] | None = None,
) -> DataFrame:
    """Cumulative incidence 1 - S and cumulative hazard on an equal grid of [0, end].

    Every distinct time is assigned to the first grid point at or after it, so the curve
    on the grid is a running sum over at most ``points`` cells per key.
    """
    keys = keys or []
    step = end / (points - 1)
    spark = df.sparkSession
    guess = F.ceil(F.col("time") / F.lit(step))
    cell = (
        F.when(F.col("time") <= (guess - 1) * F.lit(step), guess - 1)
        .when(F.col("time") > guess * F.lit(step), guess + 1)
        .otherwise(guess)
    )
    cells = (
        risk_table(df, keys, splits)
        .withColumn("cell", F.greatest(cell, F.lit(0)))
        .groupBy(*keys, "cell")
        .agg(
            F.sum(_log_step()).alias("log_s"),
            F.sum(F.col("d") / F.col("n")).alias("h"),
            F.max((F.col("d") == F.col("n")).cast("int")).alias("extinct"),
        )
    )
    grid = spark.range(points).select(F.col("id").alias("cell"))
    if keys:
        # a few cells per key: every key gets the full grid through an exploded sequence
        grid = cells.select(*keys).distinct().withColumn(
            "cell", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).cast("long")
        )
    filled = grid.join(cells.withColumn("cell", F.col("cell").cast("long")), [*keys, "cell"], "left")
    w = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("cell")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    log_s = F.coalesce(F.sum("log_s").over(w), F.lit(0.0))
    extinct = F.coalesce(F.max("extinct").over(w), F.lit(0)) == 1
    return filled.select(
        *keys,
        F.col("cell"),
        (F.col("cell") * F.lit(step)).alias("time"),
        F.when(extinct, F.lit(1.0)).otherwise(1 - F.exp(log_s)).alias("incidence"),
        F.coalesce(F.sum("h").over(w), F.lit(0.0)).alias("hazard"),
    )


@F.pandas_udf(DoubleType())
def chi2_1df_pvalue(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom (one value per test)."""
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2.0)), na_action="ignore")


def logrank(
    df: DataFrame, groups: dict[str, Column], splits: list[float] | None = None, min_side: int = 0
) -> DataFrame:
    """Two-sample log-rank tests, one per named boolean split, all in one scan.

    A true value is side A, false side B, null leaves the row out of that test. All
    tests share one aggregate per distinct time, so rows are not multiplied.
    """
    names = list(groups)
    if splits is None:
        splits = equi_depth_splits(df, TIME)
    base = df.select(
        F.col(TIME).cast("double").alias("time"),
        (F.col(EVENT) == 1).alias("__e"),
        *[groups[g].alias(f"g{i}") for i, g in enumerate(names)],
    )
    aggs = []
    for i in range(len(names)):
        g = F.col(f"g{i}")
        aggs += [
            F.count(g).alias(f"m{i}"),
            F.count_if(g).alias(f"ma{i}"),
            F.count_if(g.isNotNull() & F.col("__e")).alias(f"d{i}"),
            F.count_if(g & F.col("__e")).alias(f"da{i}"),
        ]
    table = with_bucket(base.groupBy("time").agg(*aggs), "time", splits)
    sums = {}
    for i in range(len(names)):
        sums[f"n{i}"], sums[f"na{i}"] = F.col(f"m{i}"), F.col(f"ma{i}")
    scanned = prefix_sums(table, [], "time", sums, reverse=True)
    totals = []
    for i in range(len(names)):
        n, na, d, da = (F.col(f"{c}{i}").cast("double") for c in ("n", "na", "d", "da"))
        share = F.try_divide(na, n)
        var = F.when(n > 1, d * share * (1 - share) * (n - d) / (n - 1))
        totals += [
            F.sum(da - d * share).alias(f"oe{i}"),
            F.coalesce(F.sum(var), F.lit(0.0)).alias(f"var{i}"),
            F.sum(f"ma{i}").alias(f"na{i}"),
            (F.sum(f"m{i}") - F.sum(f"ma{i}")).alias(f"nb{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(g).alias("test"),
                F.col(f"na{i}").alias("n_a"),
                F.col(f"nb{i}").alias("n_b"),
                F.col(f"oe{i}").alias("observed_minus_expected"),
                F.col(f"var{i}").alias("variance"),
            )
            for i, g in enumerate(names)
        ]
    )
    out = scanned.agg(*totals).select(F.inline(rows))
    oe = F.col("observed_minus_expected")
    return out.filter((F.col("n_a") >= min_side) & (F.col("n_b") >= min_side)).withColumn(
        "test_statistic", F.try_divide(oe * oe, F.col("variance"))
    )


def with_pvalue(tests: DataFrame) -> DataFrame:
    p = tests.withColumn("p_value", chi2_1df_pvalue("test_statistic"))
    return p.withColumns({"stars": significance_stars("p_value"), "significant": F.col("p_value") < 0.05})


def logrank_scan(df: DataFrame, features: list[str], splits: list[float] | None = None) -> DataFrame:
    """Log-rank test of every feature split at its median (<= against >), both sides >= 5."""
    medians = exact_quantiles(df, {f: nn(f) for f in features}, [0.5])
    groups = {f: nn(f) <= F.lit(medians[f][0]) for f in features if medians[f][0] is not None}
    return logrank(df, groups, splits, min_side=5)


def logrank_summary(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Tests by rising p-value with their place, and how many are significant."""
    ranked = with_pvalue(tests)
    order = Window.orderBy("p_value", F.desc("test_statistic"), "test")  # one row per feature
    return ranked.withColumn("place", F.row_number().over(order)).withColumn(
        "n_significant", F.sum((F.col("p_value") < level).cast("long")).over(Window.partitionBy())
    )


def quantile_group(df: DataFrame, column: str, n_groups: int) -> tuple[Column, list[str]]:
    """Labelled quantile group of a column; a median split when ties leave too few edges."""
    edges = exact_quantiles(df, {"x": nn(column)}, [i / n_groups for i in range(n_groups + 1)])["x"]
    distinct = sorted({e for e in edges if e is not None})
    x = nn(column)
    if len(distinct) == n_groups + 1:
        label = F.when(x.isNotNull(), F.lit("Q1"))
        for i, e in enumerate(distinct[1:-1]):
            label = F.when(x > e, F.lit(f"Q{i + 2}")).otherwise(label)
        return label, [f"Q{i + 1}" for i in range(n_groups)]
    median = exact_quantiles(df, {"x": x}, [0.5])["x"][0]
    # rows with a missing value fall on the "High" side, as a failed comparison does
    return F.when(x <= median, F.lit("Low")).otherwise(F.lit("High")), ["Low", "High"]


def stratified_km(df: DataFrame, column: str, n_groups: int = 2) -> DataFrame:
    label, _ = quantile_group(df, column, n_groups)
    grouped = df.withColumn("group", label).filter(F.col("group").isNotNull())
    return km_horizons(grouped, ["group"])


def stratified_logrank(df: DataFrame, column: str, n_groups: int = 2) -> DataFrame:
    """Log-rank test of the lowest against the highest quantile group."""
    label, names = quantile_group(df, column, n_groups)
    side = F.when(label == names[0], F.lit(True)).when(label == names[-1], F.lit(False))
    return logrank(df, {column: side})


def step_at(curve: DataFrame, times: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """Right-continuous step value at each time, clamped to the curve's own domain."""
    keys = keys or []
    first = F.min_by("survival", "time")
    values = [
        F.coalesce(
            F.max_by("survival", F.when(F.col("time") <= F.lit(float(t)), F.col("time"))), first
        ).alias(f"survival_{t}h")
        for t in times
    ]
    return (curve.groupBy(*keys) if keys else curve.groupBy()).agg(*values)


def nearest_step(curve: DataFrame, t: float, keys: list[str] | None = None) -> DataFrame:
    """Survival at the tabulated time nearest to ``t`` (the earlier one on a tie)."""
    keys = keys or []
    distance = F.struct(F.abs(F.col("time") - F.lit(float(t))), F.col("time"))
    grouped = curve.groupBy(*keys) if keys else curve.groupBy()
    return grouped.agg(F.min_by("survival", distance).alias("survival"))


def kaplan_meier_probabilities(df: DataFrame) -> dict[str, float]:
    row = km_horizons(df).first()
    return {c: row[c] for c in PROB_COLS}
