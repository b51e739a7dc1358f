"""Ordered prefix sums over a whole table without a one-partition window.

Order values are cut into many buckets of about equal depth; a window runs inside each
(key, bucket), the bucket totals (a table whose size depends only on the number of keys
and buckets) are accumulated, and the two are joined back. The caller aggregates to
distinct order values first, so a value shared by a third of all rows is one row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from durata.operators.partials import batch_matrix

MAX_BUCKETS = 4096
#: Weighted points that a task keeps a column, and rows that it reads between two reductions.
POINTS, RAW_ROWS = 4000, 500_000


def n_buckets(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_BUCKETS, 2 * partitions))


def _points(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``POINTS`` weighted points of about the same distribution."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    if len(values) <= POINTS:
        return values, weights[order]
    wanted = (np.arange(POINTS) + 0.5) * (upto[-1] / POINTS)
    return values[np.searchsorted(upto, wanted, "left")], np.full(POINTS, upto[-1] / POINTS)


def sketched_quantiles(df: DataFrame, columns: list[str], probs: list[list[float]]) -> list[np.ndarray]:
    """Approximate quantiles of numeric columns, each at probabilities of its own; missing values are skipped.

    A task keeps ``POINTS`` weighted points a column, and a column's points meet in one group:
    ranks are off by about one in twice that number, and no task merges the sketches of all
    columns. Empty for a column without values.
    """
    names = [f"c{i}" for i in range(len(columns))]
    numbers = df.selectExpr(*[f"cast(`{c}` as double) as {n}" for c, n in zip(columns, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]
        rows = 0
        for batch in batches:
            matrix = batch_matrix(batch, names)
            rows += len(matrix)
            for j, parts in enumerate(held):
                x = matrix[~np.isnan(matrix[:, j]), j]
                parts.append((x, np.ones(len(x))))
            if rows > RAW_ROWS:
                held = [[_points(*map(np.concatenate, zip(*parts, strict=True)))] for parts in held]
                rows = 0
        for j, parts in enumerate(held):
            if parts:
                x, w = _points(*map(np.concatenate, zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j)), pa.array(x), pa.array(w)], names=["col", "x", "w"])

    def pick(group: pa.Table) -> pa.Table:
        j = group.column("col")[0].as_py()
        x, w = (group.column(c).to_numpy() for c in ("x", "w"))
        order = np.argsort(x, kind="stable")
        upto = np.cumsum(w[order])
        at = np.searchsorted(upto, np.array(probs[j]) * upto[-1], "left")
        found = x[order][np.minimum(at, len(x) - 1)]
        return pa.table({"col": pa.array(np.full(len(found), j)), "i": pa.array(np.arange(len(found))), "x": pa.array(found)})

    out = [np.zeros(0) for _ in names]
    points = numbers.mapInArrow(run, "col long, x double, w double").groupBy("col")
    got = points.applyInArrow(pick, "col long, i long, x double").toArrow()
    col, i, x = (got.column(c).to_numpy() for c in ("col", "i", "x"))
    for j in np.unique(col):
        mine = col == j
        out[j] = x[mine][np.argsort(i[mine])]
    return out


def equi_depth_splits_of(
    df: DataFrame, columns: list[str], buckets: int | None = None
) -> list[list[float]]:
    """Approximate quantile cut points: they balance buckets and never affect results."""
    k = buckets or n_buckets(df)
    found = sketched_quantiles(df, columns, [[i / k for i in range(1, k)]] * len(columns))
    return [np.unique(cuts[np.isfinite(cuts)]).tolist() for cuts in found]


def equi_depth_splits(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    return equi_depth_splits_of(df, [column], buckets)[0]


def with_bucket(df: DataFrame, column: str, splits: list[float], out: str = "bucket") -> DataFrame:
    """Bucket number of a value (binary search on the cut points)."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    edges = [float("-inf"), *splits, float("inf")]
    cut = Bucketizer(splits=edges, inputCol=column, outputCol=out, handleInvalid="keep")
    return cut.transform(df).withColumn(out, F.col(out).cast("int"))


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column | str],
    bucket: str = "bucket",
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums along ``order`` within ``keys``.

    ``sums`` maps an output name to a column or SQL text. ``df`` holds one row per
    (keys, order) and a ``bucket`` that does not decrease with ``order``. ``reverse``
    accumulates from the top; ``inclusive`` counts the row itself.
    """
    tmp = {o: f"__v_{i}" for i, o in enumerate(sums)}
    texts = {o: f"coalesce({e}, 0) as {tmp[o]}" for o, e in sums.items() if isinstance(e, str)}
    exprs = {tmp[o]: F.coalesce(e, F.lit(0)) for o, e in sums.items() if not isinstance(e, str)}
    base = df.withColumns(exprs) if exprs else df
    base = base.selectExpr("*", *texts.values())
    quoted = [f"`{k}`" for k in keys]
    direction = "desc" if reverse else "asc"
    last = "current row" if inclusive else "1 preceding"
    inside = (
        f"(partition by {', '.join([*quoted, bucket])} order by `{order}` {direction} "
        f"rows between unbounded preceding and {last})"
    )
    steps = (
        f"(partition by {', '.join(quoted) or '0'} order by {bucket} {direction} "
        "rows between unbounded preceding and 1 preceding)"
    )
    totals = base.groupBy(*keys, bucket).agg(*[F.expr(f"sum({t}) as {t}") for t in tmp.values()])
    offsets = totals.selectExpr(
        *quoted, bucket, *[f"coalesce(sum({t}) over {steps}, 0) as {t}o" for t in tmp.values()]
    )
    local = base.selectExpr(
        "*", *[f"coalesce(sum({t}) over {inside}, 0) as {t}l" for t in tmp.values()]
    )
    kept = [f"`{c}`" for c in df.columns if c not in sums]
    return local.join(offsets, [*keys, bucket]).selectExpr(
        *kept, *[f"{t}l + {t}o as `{o}`" for o, t in tmp.items()]
    )


def positions(df: DataFrame, order: str, tie: str, out: str = "position") -> DataFrame:
    """1-based position of every row in (order, tie) without a one-task sort.

    Rows before = rows with a smaller ``order`` (a scan over distinct values) + rows of
    the same value in earlier ``tie`` buckets + the rank inside (value, bucket), so a
    value shared by a third of all rows is still ranked by many tasks.
    """
    by_order, by_tie = equi_depth_splits_of(df, [order, tie])
    rows = with_bucket(df, tie, by_tie, "__tb")
    cells = rows.groupBy(order, "__tb").agg(F.count("*").alias("__n"))
    values = cells.groupBy(order).agg(F.sum("__n").alias("__n"))
    below = prefix_sums(
        with_bucket(values, order, by_order), [], order, {"__below": "__n"}, inclusive=False
    ).select(order, "__below")
    earlier = Window.partitionBy(order).orderBy("__tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.withColumn("__earlier", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .join(below, order)
        .select(order, "__tb", (F.col("__below") + F.col("__earlier")).alias("__offset"))
    )
    rank = F.row_number().over(Window.partitionBy(order, "__tb").orderBy(tie))
    return (
        rows.withColumn("__rank", rank)
        .join(offsets, [order, "__tb"])
        .withColumn(out, F.col("__rank") + F.col("__offset"))
        .drop("__tb", "__rank", "__offset")
    )
