"""Group statistics, correlations and band summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import CORRELATION_THRESHOLD, EVENT, HORIZONS, TIME
from durata.functions.columns import nn
from durata.functions.features import quantile_bin
from durata.operators.partials import partition_sums
from durata.operators.quality import _sql_value, long_form
from durata.operators.quantiles import exact_quantiles, keyed_quantiles
from durata.operators.scan import positions



def horizon_counts(df: DataFrame) -> DataFrame:
    """Hits by each horizon, and their share of all subjects, from one aggregate."""
    aggs = [f"count_if(`{EVENT}` = 1 and `{TIME}` <= {h}) as h{h}" for h in HORIZONS]
    rows = ", ".join(
        f"named_struct('horizon',{h},'hits',h{h},'rate',h{h} / nullif(n, 0))" for h in HORIZONS
    )
    return df.selectExpr("count(*) as n", *aggs).selectExpr(f"inline(array({rows}))")


def censoring_summary(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "count(*) as n",
        f"count_if(`{EVENT}` = 1) as n_events",
        f"count_if(`{EVENT}` = 0) as n_censored",
        f"avg(double(`{EVENT}` = 0)) as censoring_rate",
        f"avg(double(`{EVENT}` = 1)) as event_rate",
    )


def target_stats(df: DataFrame) -> DataFrame:
    median = exact_quantiles(df, {TIME: nn(TIME)}, [0.5])[TIME][0]
    return df.agg(
        F.min(TIME).alias("min"), F.max(TIME).alias("max"), F.avg(TIME).alias("mean"),
        F.stddev_samp(TIME).alias("std"),
    ).withColumn("median", F.lit(median))


def describe_by(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per group value and column.

    Groups may be many or hot; rows without a group are left out.
    """
    long = df.select(
        group, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), nn(c).alias("value")) for c in columns]))
    )
    quartiles = keyed_quantiles(long, [group, "feature"], "value", [0.25, 0.5, 0.75]).selectExpr(
        f"`{group}`", "feature", *[f"quantiles[{i}] as {q}" for i, q in enumerate(("q25", "q50", "q75"))]
    )
    aggs = []
    for i, c in enumerate(columns):
        v = _sql_value(c)
        for fn, out in (
            ("count", "count"), ("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")
        ):
            aggs.append(F.expr(f"{fn}({v})").alias(f"c{i}_{out}"))
    structs = [
        f"named_struct('feature','{c}','count',c{i}_count,'mean',c{i}_mean,'std',c{i}_std,"
        f"'min',c{i}_min,'max',c{i}_max)"
        for i, c in enumerate(columns)
    ]
    wide = df.groupBy(group).agg(*aggs).selectExpr(f"`{group}`", f"inline(array({', '.join(structs)}))")
    known = wide.where(F.col(group).isNotNull())
    return known.join(quartiles, [group, "feature"], "left")


def hit_rate_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(
        F.avg(F.col(EVENT).cast("double")).alias("hit_rate"), F.count("*").alias("n")
    )


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Hit rate and count per value of each flag, in one pass."""
    structs = ", ".join(f"named_struct('feature','{c}','value',cast(`{c}` as long))" for c in flags)
    tall = df.selectExpr(f"`{EVENT}`", f"inline(array({structs}))")
    return tall.groupBy("feature", "value").agg(
        F.avg(F.col(EVENT).cast("double")).alias("hit_rate"), F.count("*").alias("n")
    )


def feature_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(columns):
        aggs += [f"avg({_sql_value(c)}) as c{i}_m", f"stddev_samp({_sql_value(c)}) as c{i}_s"]
    return long_form(df.selectExpr(*aggs), columns, {"mean": "m", "std": "s"})


def subset_quantile(df: DataFrame, condition, column: str = TIME, q: float = 0.9) -> DataFrame:
    """Quantile, median and mean of a column over the rows that satisfy a condition."""
    part = df.filter(condition)
    hi, median = exact_quantiles(part, {column: nn(column)}, [q, 0.5])[column]
    return part.agg(F.count("*").alias("n"), F.avg(column).alias("mean")).withColumns(
        {"q": F.lit(q), "quantile": F.lit(hi), "median": F.lit(median)}
    )


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pairwise-complete Pearson matrix; NaN where a side is constant.

    Sums of centred products per partition, so the work is one narrow pass and the
    driver sees a matrix of the number of columns squared.
    """
    p = len(columns)
    means = df.selectExpr(*[f"coalesce(avg({_sql_value(c)}), 0D)" for c in columns]).first()
    centre = np.array(means, dtype=float)

    def products(x: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(x)
        z = np.where(seen, x - centre, 0.0)
        m = seen.astype(float)
        return np.concatenate(
            [(m.T @ m).ravel(), (z.T @ m).ravel(), ((z * z).T @ m).ravel(), (z.T @ z).ravel()]
        )

    numbers = df.selectExpr(*[f"{_sql_value(c)} as `{c}`" for c in columns])
    n, sx, sxx, sxy = partition_sums(numbers, products, 4 * p * p).reshape(4, p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy - sx * sx.T / n
        var = sxx - sx * sx / n
        scale = np.abs(sxx) + 1e-300
        var = np.where(var / scale < 1e-13, np.nan, var)
        r = cov / np.sqrt(var * var.T)
    return np.clip(r, -1.0, 1.0)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    r = correlations(df, columns)
    rows = [
        (a, b, None if np.isnan(r[i, j]) else float(r[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, r double")


def pairs_over(r: np.ndarray, columns: list[str], threshold: float) -> list[tuple[str, str, float]]:
    """Pairs with |r| above the threshold, strongest first, four decimals."""
    found = [
        (columns[i], columns[j], round(float(abs(r[i, j])), 4))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
        if abs(r[i, j]) > threshold
    ]
    return sorted(found, key=lambda t: (-t[2], t[0], t[1]))


def correlated_pairs(
    df: DataFrame, columns: list[str], threshold: float = CORRELATION_THRESHOLD
) -> DataFrame:
    rows = pairs_over(correlations(df, columns), columns, threshold)
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, r double")


def target_correlation(df: DataFrame, columns: list[str], target: str = TIME) -> DataFrame:
    """Correlation of every column with one target (point-biserial for a 0/1 target)."""
    r = correlations(df, [*columns, target])[:-1, -1]
    rows = [(c, None if np.isnan(v) else float(v)) for c, v in zip(columns, r, strict=True)]
    out = df.sparkSession.createDataFrame(rows, "feature string, r double")
    return out.orderBy(F.abs("r").desc_nulls_last(), "feature")


def band_rates(df: DataFrame, column: str, q: int = 4, error: str | None = None) -> DataFrame:
    """Hit rate, count (and mean error) per quantile band, lowest band Q1."""
    edges = exact_quantiles(df, {column: nn(column)}, [i / q for i in range(q + 1)])[column]
    band = quantile_bin(column, sorted({e for e in edges if e is not None}))
    aggs = [F.count("*").alias("n"), F.avg(F.col(EVENT).cast("double")).alias("hit_rate")]
    if error:
        aggs.append(F.avg(error).alias("mean_error"))
    return (
        df.withColumn("band", F.concat(F.lit("Q"), (band + 1).cast("string")))
        .filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(*aggs)
    )


def event_timeline(df: DataFrame, id_col: str) -> DataFrame:
    """Subjects with their position in order of duration, id breaks ties."""
    return positions(df.select(id_col, TIME, EVENT), TIME, id_col)
