"""Feature ranking and selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import CORRELATION_THRESHOLD, MI_THRESHOLD, TIME
from durata.functions.columns import nn
from durata.operators.partials import partition_cells
from durata.operators.quality import _sql_value
from durata.operators.quantiles import exact_quantiles
from durata.operators.stats import correlations

MI_BINS = 16


def mutual_information(
    df: DataFrame, columns: list[str], target: str = TIME, bins: int = MI_BINS
) -> DataFrame:
    """Binned mutual information (nats) of each column with the target, highest first.

    Both sides are cut at their quantiles; a task counts its rows into ``bins`` squared cells
    per column, whatever the number of rows.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(df, {c: nn(c) for c in [*columns, target]}, probs)
    inner = {c: np.array(sorted({float(e) for e in x if e is not None})[1:-1]) for c, x in edges.items()}

    def cells(x: np.ndarray) -> np.ndarray:
        y = x[:, -1]
        by = np.searchsorted(inner[target], y, "left")
        out = np.zeros((len(columns), bins * bins))
        for j, c in enumerate(columns):
            seen = ~(np.isnan(x[:, j]) | np.isnan(y))
            bx = np.searchsorted(inner[c], x[seen, j], "left")
            out[j] = np.bincount(bx * bins + by[seen], minlength=bins * bins)
        return out.ravel()

    numbers = df.selectExpr(*[f"{_sql_value(c)} as `c{i}`" for i, c in enumerate([*columns, target])])
    names = F.array(*[F.lit(c) for c in columns])
    joint = partition_cells(numbers, cells, len(columns) * bins * bins).where("v > 0").select(
        names[F.expr(f"pos div {bins * bins}").cast("int")].alias("feature"),
        F.expr(f"pos div {bins} % {bins}").alias("bx"), F.expr(f"pos % {bins}").alias("by"), F.col("v").alias("n"),
    )
    px = joint.groupBy("feature", "bx").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("feature", "by").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    out = joint.join(px, ["feature", "bx"]).join(py, ["feature", "by"]).join(total, "feature")
    mi = out.groupBy("feature").agg(F.expr("sum(n / nt * ln(n * nt / (nx * ny)))").alias("mi_score"))
    return mi.orderBy(F.col("mi_score").desc(), "feature")


def select_features(
    df: DataFrame,
    columns: list[str],
    target: str = TIME,
    mi_threshold: float = MI_THRESHOLD,
    corr_threshold: float = CORRELATION_THRESHOLD,
) -> list[str]:
    """Informative columns of which no two are highly correlated, most informative first.

    One pass down the rank table of scores above ``mi_threshold``: a column stays unless it
    correlates beyond ``corr_threshold`` with one that stayed before it. Equal scores (to
    twelve decimals) rank by name.
    """
    table = mutual_information(df, columns, target).filter(F.col("mi_score") > mi_threshold)
    names = [r[0] for r in table.orderBy(F.round("mi_score", 12).desc(), "feature").collect()]
    if len(names) < 2:
        return names
    size = np.abs(correlations(df, names))
    stay: list[int] = []
    for i in range(len(names)):
        if not (size[i, stay] > corr_threshold).any():
            stay.append(i)
    return [names[i] for i in stay]
