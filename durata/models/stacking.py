"""Meta-learners over member predictions, and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import EVENT, HORIZONS, ID, PROB_COLS, TIME
from durata.functions.columns import enforce_monotonicity
from durata.functions.labels import horizon_label, scored_at
from durata.models.base import FIT_THREADS
from durata.models.trees import pass_partitions
from durata.operators.ensemble import members_wide


def pooled_blocks(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Pool adjacent violators: neighbouring blocks merge until their means rise.

    Blocks are given by first and last score, sum of labels and weight. Which neighbours
    merge first does not matter, so blocks pooled from parts can be pooled again.
    """
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist(), strict=True):
        a, b, y, w = block
        while out and out[-1][2] * w >= y * out[-1][3]:
            a, _, y0, w0 = out.pop()
            y, w = y + y0, w + w0
        out.append([a, b, y, w])
    return list(np.array(out, dtype=float).reshape(-1, 4).T)


def isotonic_knots(labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scores and fitted values at both ends of every block, from (score, y) rows.

    Equal scores collapse first; scores are ranged over the partitions, each pools its own
    range, and what is left is pooled once more. Exact for any number of scores.
    """
    points = labels.groupBy("score").agg(
        F.sum(F.col("y").cast("double")).alias("total"), F.count("*").cast("double").alias("weight")
    )
    ranged = points.repartitionByRange("score").sortWithinPartitions("score")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0)] * 4
        for b in batches:
            x, y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("score", "total", "weight"))
            kept = pooled_blocks(*[np.concatenate([k, v]) for k, v in zip(kept, (x, x, y, w), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(k) for k in kept], names=["low", "high", "total", "weight"])

    blocks = ranged.mapInArrow(pool, "low double, high double, total double, weight double").toArrow()
    found = [blocks.column(c).to_numpy() for c in ("low", "high", "total", "weight")]
    order = np.argsort(found[0], kind="stable")
    low, high, total, weight = pooled_blocks(*[x[order] for x in found])
    value = total / weight
    return np.column_stack([low, high]).ravel(), np.repeat(value, 2)


@dataclass
class MetaLearner:
    """Per-horizon logistic regression on the members' probabilities.

    Fitted on out-of-fold predictions it is stacking, on one holdout it is blending.
    Predictions are long: (id, model, probabilities), plus the targets when fitting.
    """

    c: float = 1.0
    members: list[str] = field(default_factory=list)
    models: list[Any] = field(default_factory=list)

    def _vector(self, wide: DataFrame, col: str) -> DataFrame:
        parts = [f"{col}__{i}" for i in range(len(self.members))]
        return VectorAssembler(inputCols=parts, outputCol="__m", handleInvalid="keep").transform(wide)

    def fit(self, predictions: DataFrame, members: list[str]) -> MetaLearner:
        if not members:
            raise ValueError("no members given")
        wide = members_wide(predictions, members, [TIME, EVENT]).persist()
        self.fit_wide(wide, members)
        wide.unpersist()
        return self

    def fit_wide(self, wide: DataFrame, members: list[str]) -> MetaLearner:
        """As ``fit``, from stored rows of ``members_wide`` with the targets."""
        if not members:
            raise ValueError("no members given")
        self.members = list(members)
        n, *spans = wide.select(*[horizon_label(h).alias(f"y{h}") for h in HORIZONS]).selectExpr(
            "count(*)", *[f"array(min(y{h}), max(y{h}))" for h in HORIZONS]
        ).first()
        parts = pass_partitions(wide)

        def one(i: int) -> Any:
            lo, hi = spans[i]
            if lo == hi:  # one class only
                return float(lo or 0)
            label = horizon_label(HORIZONS[i]).cast("double").alias("label")
            est = LogisticRegression(
                featuresCol="__m", regParam=1.0 / (self.c * max(n, 1)), elasticNetParam=0.0,
                standardization=False, maxIter=1000,
            )
            # every step of the fit is a pass over these rows
            return est.fit(self._vector(wide, PROB_COLS[i]).select("__m", label).coalesce(parts))

        with ThreadPoolExecutor(FIT_THREADS) as pool:
            self.models = list(pool.map(one, range(len(HORIZONS))))
        return self

    def predict(self, predictions: DataFrame) -> DataFrame:
        have = {r[0] for r in predictions.select("model").distinct().collect()}
        if have != set(self.members):
            raise ValueError(f"expected {len(self.members)} models, got {len(have)}")
        return self.combine(members_wide(predictions, self.members)).select(ID, *PROB_COLS)

    def combine(self, wide: DataFrame) -> DataFrame:
        """The rows of ``members_wide`` with the combined probabilities, row by row."""
        out, kept = wide, [c for c in wide.columns if c not in PROB_COLS]
        for h, m in zip(HORIZONS, self.models, strict=True):
            col = f"prob_{h}h"
            if isinstance(m, float):
                out = out.withColumn(col, F.lit(m))
                continue
            for old in ("__p", "__r", "__c"):
                out = out.drop(old)
            m = m.copy()
            m.setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__c")
            p = vector_to_array(F.col("__p"))[1]
            out = m.transform(self._vector(out, col)).withColumn(
                col, F.coalesce(F.nanvl(p, F.lit(None)), F.lit(0.0))
            ).drop("__m")
        return enforce_monotonicity(out.select(*kept, *PROB_COLS))


@dataclass
class IsotonicCalibrator:
    """Isotonic regression per horizon on the rows whose status there is known.

    A horizon with too few hits keeps its raw probabilities. Between the fitted blocks
    values are interpolated, beyond them they stay level.
    """

    min_events: int = 5
    models: dict[int, Any] = field(default_factory=dict)

    def fit(self, predictions: DataFrame) -> IsotonicCalibrator:
        rows = predictions.select(TIME, EVENT, *PROB_COLS).persist()
        positives = rows.agg(
            *[F.sum(F.when(scored_at(h), horizon_label(h))).alias(f"n{h}") for h in HORIZONS]
        ).first()
        for h in HORIZONS:
            if (positives[f"n{h}"] or 0) < self.min_events:
                self.models[h] = None
                continue
            known = rows.filter(scored_at(h)).select(
                F.col(f"prob_{h}h").cast("double").alias("score"), horizon_label(h).alias("y")
            )
            self.models[h] = isotonic_knots(known.where("score is not null and not isnan(score)"))
        rows.unpersist()
        return self

    def transform(self, predictions: DataFrame) -> DataFrame:
        if not self.models:
            raise RuntimeError("fit the calibrator before transform")
        names = predictions.columns
        out = predictions
        for h in HORIZONS:
            m = self.models.get(h)
            if m is None:
                continue
            c, (x, y) = f"prob_{h}h", m
            fitted = F.pandas_udf(lambda v, x=x, y=y: pd.Series(np.interp(v, x, y)), "double")
            out = out.withColumn(c, fitted(F.col(c).cast("double")))
        return enforce_monotonicity(out.select(*names))

    def fit_transform(self, predictions: DataFrame, target: DataFrame | None = None) -> DataFrame:
        return self.fit(predictions).transform(predictions if target is None else target)

    def summary(self) -> dict[int, str]:
        return {h: "skipped" if m is None else "fitted" for h, m in self.models.items()}
