"""Marginal Kaplan-Meier baseline: the same four probabilities for every subject."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import PROB_COLS
from durata.functions.columns import enforce_monotonicity
from durata.models.base import HorizonModel
from durata.operators.survival import kaplan_meier_probabilities


@dataclass
class KaplanMeierModel(HorizonModel):
    features: list[str] = field(default_factory=list)
    probs: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, features: list[str] | None = None) -> KaplanMeierModel:
        self.probs = kaplan_meier_probabilities(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({c: F.lit(float(self.probs[c])) for c in PROB_COLS})
        return enforce_monotonicity(out)
