"""Seed ensemble: the same model under several seeds, probabilities averaged."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import ENSEMBLE_SEEDS, PROB_COLS
from durata.functions.columns import enforce_monotonicity
from durata.models.base import FIT_THREADS, HorizonModel, default_features


@dataclass
class SeedEnsemble(HorizonModel):
    """``factory(seed)`` returns an unfitted model."""

    factory: Callable[[int], HorizonModel]
    seeds: tuple[int, ...] = ENSEMBLE_SEEDS
    features: list[str] = field(default_factory=list)
    models: list[HorizonModel] = field(default_factory=list)

    def fit(self, df: DataFrame, features: list[str] | None = None) -> SeedEnsemble:
        if not self.seeds:
            raise ValueError("at least one seed is needed")
        self.features = default_features(df, features)
        with ThreadPoolExecutor(FIT_THREADS) as pool:
            self.models = list(pool.map(lambda s: self.factory(s).fit(df, self.features), self.seeds))
        return self

    def fit_folds(self, df, features, folds, fold_col="fold"):
        features = default_features(df, features)
        with ThreadPoolExecutor(FIT_THREADS) as pool:
            per_seed = list(pool.map(lambda s: self.factory(s).fit_folds(df, features, folds, fold_col), self.seeds))
        return {
            f: SeedEnsemble(self.factory, self.seeds, features, [m[f] for m in per_seed]) for f in folds
        }

    def predict(self, df: DataFrame) -> DataFrame:
        """Every member adds its columns to the same row; no join is needed."""
        kept = [c for c in df.columns if c not in PROB_COLS]
        out = df.select(*kept)
        for i, m in enumerate(self.models):
            scored = m.predict(out)
            out = scored.withColumnsRenamed({c: f"__s{i}_{c}" for c in PROB_COLS})
        n = len(self.models)
        means = {
            c: sum((F.col(f"__s{i}_{c}") for i in range(1, n)), F.col(f"__s0_{c}")) / n for c in PROB_COLS
        }
        return enforce_monotonicity(out.withColumns(means)).select(*kept, *PROB_COLS)
