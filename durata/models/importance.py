"""Permutation importance, recursive elimination, top-N comparison, adversarial validation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import ID
from durata.functions.columns import factorize
from durata.functions.impute import MedianImputer, impute_jointly
from durata.functions.labels import horizon_label
from durata.models.base import ModelFactory, default_features
from durata.models.validation import cross_validate
from durata.operators.metrics import score_auc
from durata.operators.resample import class_rank, stratified_folds


def _labelled(df: DataFrame, features: list[str]) -> DataFrame:
    """Imputed features and the hit-by-72h label."""
    rows = factorize(df.select(ID, *features, horizon_label(72).cast("double").alias("label")), [
        c for c, t in df.dtypes if t == "string" and c in features
    ])
    return MedianImputer(features).fit(rows).transform(rows)


def _forest(trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=512
    )


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="x").transform(df)


def permutation_importance(
    df: DataFrame,
    features: list[str] | None = None,
    n_repeats: int = 8,
    seed: int = 42,
    trees: int = 150,
    max_depth: int = 12,
) -> DataFrame:
    """Drop in accuracy when one column is shuffled: (feature, mean, std), largest first.

    A repeat pairs every row with the row at the same place in an order by hashed ids
    (ranks are counted in hash buckets), which is one random permutation; every feature
    is then replaced in turn and all features are scored in one pass.
    """
    features = default_features(df, features)
    rows = _labelled(df, features).withColumn("__all", F.lit(1)).persist()
    model = _forest(trees, max_depth, seed).fit(_assemble(rows, features))
    hit = (F.col("prediction") == F.col("label")).cast("double")
    base = model.transform(_assemble(rows, features)).agg(F.avg(hit)).first()[0]
    drops: dict[str, list[float]] = {f: [] for f in features}
    for r in range(n_repeats):
        here = class_rank(rows, seed * 1000 + 2 * r, ID, "__all").drop("__class_size", "__all")
        there = class_rank(rows.select(ID, "__all", *features), seed * 1000 + 2 * r + 1, ID, "__all")
        other = there.select("__rank", *[F.col(f).alias(f"__p_{f}") for f in features])
        paired = here.join(other, "__rank")
        variants = F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("f"),
                        *[F.col(f"__p_{g}" if g == f else g).alias(f"v{j}") for j, g in enumerate(features)],
                    )
                    for i, f in enumerate(features)
                ]
            )
        )
        tall = paired.select("label", variants)
        scored = model.transform(_assemble(tall, [f"v{j}" for j in range(len(features))]))
        for row in scored.groupBy("f").agg(F.avg(hit).alias("acc")).collect():
            drops[features[row["f"]]].append(base - row["acc"])
    rows.unpersist()
    table = [(f, float(np.mean(d)), float(np.std(d))) for f, d in drops.items()]
    table.sort(key=lambda t: (-t[1], t[0]))
    return df.sparkSession.createDataFrame(
        table, "feature string, importance_mean double, importance_std double"
    )


def recursive_elimination(
    df: DataFrame,
    features: list[str] | None = None,
    keep: int = 30,
    step: int = 5,
    seed: int = 42,
    trees: int = 120,
    max_depth: int = 12,
) -> list[str]:
    """Drop the least important columns, ``step`` at a time, until ``keep`` remain."""
    features = default_features(df, features)
    if keep >= len(features):
        return features
    step = max(1, min(step, len(features) - keep))
    rows = _labelled(df, features).persist()
    left = list(features)
    while len(left) > keep:
        model = _forest(trees, max_depth, seed).fit(_assemble(rows, left))
        scores = model.featureImportances.toArray()
        order = sorted(range(len(left)), key=lambda i: (scores[i], -i))
        gone = {left[i] for i in order[: min(step, len(left) - keep)]}
        left = [c for c in left if c not in gone]
    rows.unpersist()
    return left


def compare_top_n(
    df: DataFrame,
    ranking: list[str],
    factory: ModelFactory,
    n_list: tuple[int, ...] = (20, 30, 50),
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Cross-validated mean Brier of the model on the first N ranked columns."""
    out = []
    for n in n_list:
        cols = ranking[: min(n, len(ranking))]
        summary = cross_validate(factory, df, cols, k, seed).filter("metric = 'brier_mean'").first()
        out.append((int(n), len(cols), summary["mean"], summary["std"]))
    return df.sparkSession.createDataFrame(
        out, "top_n int, n_features int, brier_mean_cv double, brier_std_cv double"
    )


def shift_verdict(auc_mean: float) -> str:
    if auc_mean < 0.55:
        return "no meaningful shift"
    return "mild shift" if auc_mean < 0.65 else "significant shift"


def adversarial_validation(
    train: DataFrame,
    test: DataFrame,
    features: list[str] | None = None,
    k: int = 5,
    trees: int = 400,
    max_depth: int = 6,
    seed: int = 42,
    top: int = 15,
) -> tuple[DataFrame, DataFrame]:
    """Can a forest tell the splits apart? (AUC summary, top importances with ranks)."""
    features = default_features(test, features)
    a, b = impute_jointly(train.select(ID, *features), test.select(ID, *features), features)
    both = a.withColumn("label", F.lit(0.0)).unionByName(b.withColumn("label", F.lit(1.0)))
    rows = _assemble(stratified_folds(both, k, seed, ID, "label"), features).select(
        "x", "label", "fold"
    ).persist()
    scored = None
    for f in range(k):
        model = _forest(trees, max_depth, seed).fit(rows.filter(F.col("fold") != f))
        part = model.transform(rows.filter(F.col("fold") == f)).select(
            "fold", "label", vector_to_array(F.col("probability"))[1].alias("prob")
        )
        scored = part if scored is None else scored.unionByName(part)
    aucs = score_auc(scored, ["fold"])
    summary = aucs.agg(
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.count("auc").alias("folds")
    )
    verdict = (
        F.when(F.col("auc_mean") < 0.55, shift_verdict(0.0))
        .when(F.col("auc_mean") < 0.65, shift_verdict(0.6))
        .otherwise(shift_verdict(1.0))
    )
    full = _forest(trees, max_depth, seed).fit(rows)
    scores = full.featureImportances.toArray()
    ranked = sorted(zip(features, scores.tolist(), strict=True), key=lambda t: (-t[1], t[0]))[:top]
    table = [(i + 1, f, s) for i, (f, s) in enumerate(ranked)]
    return summary.withColumn("verdict", verdict), train.sparkSession.createDataFrame(
        table, "rank int, feature string, importance double"
    )
