"""Stratified folds and holdouts from hashed ids, exact class balance, no single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from durata.constants import EVENT, ID


def fold_hash(seed: int | Column, id_col: str = ID) -> Column:
    """md5 of id and seed: the same text in every engine."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), seed))


def class_rank(df: DataFrame, seed: int, id_col: str = ID, strata: str = EVENT, digits: int = 3) -> DataFrame:
    """1-based rank of the hashed id within its class (``__rank``), plus the class size.

    Hashes are uniform, so their leading hex digits cut every class into 16**digits even
    buckets: ranks are counted inside buckets, bucket offsets come from a table of at
    most classes * 16**digits rows.
    """
    h = df.withColumn("__h", fold_hash(seed, id_col)).withColumn(
        "__b", F.substring("__h", 1, digits)
    )
    inside = Window.partitionBy(strata, "__b").orderBy("__h", id_col)
    steps = Window.partitionBy(strata).orderBy("__b")
    sizes = h.groupBy(strata, "__b").agg(F.count("*").alias("__n"))
    offsets = sizes.select(
        strata, "__b",
        (F.sum("__n").over(steps) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(strata)).alias("__class_size"),
    )
    ranked = h.withColumn("__r", F.row_number().over(inside)).join(offsets, [strata, "__b"])
    return ranked.withColumn("__rank", F.col("__r") + F.col("__before")).drop(
        "__h", "__b", "__r", "__before"
    )


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 42, id_col: str = ID, strata: str = EVENT
) -> DataFrame:
    """Adds ``fold`` in 0..k-1; class counts differ by at most one between folds."""
    ranked = class_rank(df, seed, id_col, strata)
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop(
        "__rank", "__class_size"
    )


def repeated_folds(df: DataFrame, k: int, repeats: int, base_seed: int = 42, id_col: str = ID) -> DataFrame:
    """Long (id, repeat, fold) for several fold seeds."""
    out = None
    for r in range(repeats):
        one = stratified_folds(df, k, base_seed + r, id_col).withColumn("repeat", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def stratified_holdout(
    df: DataFrame, fraction: float = 0.25, seed: int = 42, id_col: str = ID, strata: str = EVENT
) -> DataFrame:
    """Adds boolean ``holdout``: the first ``round(fraction * size)`` hashes of each class."""
    ranked = class_rank(df, seed, id_col, strata)
    wanted = F.round(F.lit(fraction) * F.col("__class_size"))
    return ranked.withColumn("holdout", F.col("__rank") <= wanted).drop("__rank", "__class_size")
