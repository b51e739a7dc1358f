"""One built-in binary classifier per horizon on shared standardised features."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import HORIZONS, PROB_COLS
from durata.functions.columns import enforce_monotonicity
from durata.functions.impute import MedianImputer, Standardizer
from durata.functions.labels import horizon_label
from durata.models.base import FIT_THREADS, HorizonModel, default_features


@dataclass
class HorizonClassifiers(HorizonModel):
    """``build(n_rows, seed)`` returns an unfitted classifier for one horizon."""

    build: Callable[[int, int], Any]
    seed: int = 42
    features: list[str] = field(default_factory=list)
    imputer: MedianImputer | None = None
    scaler: Standardizer | None = None
    models: list[Any] = field(default_factory=list)

    def _assembled(self, df: DataFrame) -> DataFrame:
        filled = self.imputer.transform(df.withColumns({f"__f_{c}": F.col(c) for c in self.features}))
        scaled = self.scaler.transform(filled)
        vec = VectorAssembler(inputCols=self.features, outputCol="__x").transform(scaled)
        # the caller's own columns come back unscaled
        back = vec.drop(*self.features)
        return back.withColumnsRenamed({f"__f_{c}": c for c in self.features})

    def fit(self, df: DataFrame, features: list[str] | None = None) -> HorizonClassifiers:
        self.features = default_features(df, features)
        self.imputer = MedianImputer(self.features).fit(df)
        self.scaler = Standardizer(self.features).fit(self.imputer.transform(df))
        labels = [horizon_label(h).cast("double").alias(f"y{h}") for h in HORIZONS]
        rows = self._assembled(df).select("__x", *labels).persist()
        n, *means = rows.selectExpr("count(*)", *[f"avg(y{h})" for h in HORIZONS]).first()

        def one(i: int) -> Any:
            rate = float(means[i] or 0.0)
            if rate in (0.0, 1.0):  # one class only: that class's probability
                return rate
            est = self.build(n, self.seed)
            est.setFeaturesCol("__x").setLabelCol(f"y{HORIZONS[i]}")
            est.setProbabilityCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setPredictionCol(f"__c{i}")
            return est.fit(rows)

        with ThreadPoolExecutor(FIT_THREADS) as pool:
            self.models = list(pool.map(one, range(len(HORIZONS))))
        rows.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in PROB_COLS]
        out = self._assembled(df.select(*kept))
        for i, (m, c) in enumerate(zip(self.models, PROB_COLS, strict=True)):
            if isinstance(m, float):
                out = out.withColumn(c, F.lit(m))
            else:
                out = m.transform(out).withColumn(c, vector_to_array(F.col(f"__p{i}"))[1])
        return enforce_monotonicity(out.select(*kept, *PROB_COLS))


def logistic_model(c: float = 1.0, max_iter: int = 1000, seed: int = 42) -> HorizonClassifiers:
    """L2 logistic regression; the penalty weight is 1 / (C n) of the mean loss."""

    def build(n: int, seed: int) -> LogisticRegression:
        return LogisticRegression(
            regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter
        )

    return HorizonClassifiers(build, seed)


def random_forest_model(trees: int = 100, max_depth: int = 30, seed: int = 42) -> HorizonClassifiers:
    def build(n: int, seed: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            numTrees=trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed,
            maxMemoryInMB=512,
        )

    return HorizonClassifiers(build, seed)


def gradient_boosted_model(
    trees: int = 200, max_depth: int = 3, rate: float = 0.1, subsample: float = 0.8, seed: int = 42
) -> HorizonClassifiers:
    def build(n: int, seed: int) -> GBTClassifier:
        return GBTClassifier(
            maxIter=trees, maxDepth=max_depth, stepSize=rate, subsamplingRate=subsample, seed=seed,
            checkpointInterval=10,
        )

    return HorizonClassifiers(build, seed)
