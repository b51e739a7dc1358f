"""Shared shape of the horizon models: fit on a subject frame, append ``prob_*`` columns."""

from __future__ import annotations

import copy
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from durata.constants import PROB_COLS
from durata.functions.columns import numeric_columns

FIT_THREADS = 4
PROB_STRUCT = StructType([StructField(c, DoubleType()) for c in PROB_COLS])


class HorizonModel:
    """Subclasses set ``features`` in ``fit`` and implement ``fit`` and ``predict``."""

    features: list[str]

    def fit(self, df: DataFrame, features: list[str] | None = None) -> HorizonModel:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict_event(self, df: DataFrame) -> DataFrame:
        """Hard prediction: hit by 72 h at probability one half."""
        return self.predict(df).withColumn("predicted", (F.col("prob_72h") >= 0.5).cast("int"))

    def fit_folds(
        self, df: DataFrame, features: list[str] | None, folds: list[int], fold_col: str = "fold"
    ) -> dict[int, HorizonModel]:
        """One model per fold, trained on the other folds.

        Independent fits are submitted from a few driver threads; models that can share
        their jobs between folds override this.
        """

        def one(fold: int) -> HorizonModel:
            return copy.deepcopy(self).fit(df.filter(F.col(fold_col) != fold), features)

        with ThreadPoolExecutor(FIT_THREADS) as pool:
            return dict(zip(folds, pool.map(one, folds), strict=True))


ModelFactory = Callable[[], HorizonModel]


def default_features(df: DataFrame, features: list[str] | None) -> list[str]:
    skip = ("fold", "repeat", "user_id", "k", "value")
    return features or [c for c in numeric_columns(df) if c not in skip]


def with_probabilities(
    df: DataFrame, features: list[str], fn: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """Append the four probabilities computed by a vectorised function of the features."""

    def run(*cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        p = np.clip(np.maximum.accumulate(fn(x), axis=1), 0.0, 1.0)
        return pd.DataFrame(p, columns=PROB_COLS)

    udf = F.pandas_udf(run, PROB_STRUCT)
    args = [F.col(c).cast("double") for c in features]
    kept = [c for c in df.columns if c not in PROB_COLS]
    return df.select(*kept, udf(*args).alias("__p")).select(*kept, "__p.*")
