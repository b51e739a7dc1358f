"""Median imputation with medians frozen at fit, and standardisation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.functions.columns import nn
from durata.operators.quantiles import exact_quantiles


@dataclass
class MedianImputer:
    """Replaces null and NaN by the training median, as doubles."""

    columns: list[str]
    medians: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> MedianImputer:
        got = exact_quantiles(df, {c: nn(c) for c in self.columns}, [0.5])
        self.medians = {c: (0.0 if v[0] is None else float(v[0])) for c, v in got.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.coalesce(nn(c), F.lit(m)) for c, m in self.medians.items()}
        )


@dataclass
class Standardizer:
    """Centre and scale by mean and population standard deviation (constant columns by 1)."""

    columns: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Standardizer:
        row = df.selectExpr(
            *[e for c in self.columns for e in (f"avg(`{c}`)", f"stddev_pop(`{c}`)")]
        ).first()
        for i, c in enumerate(self.columns):
            m, s = row[2 * i], row[2 * i + 1]
            self.mean[c] = float(m or 0.0)
            self.scale[c] = float(s) if s and s > 1e-12 * max(1.0, abs(m)) else 1.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        z = {c: f"(`{c}` - {self.mean[c]!r}D) / {self.scale[c]!r}D as `{c}`" for c in self.columns}
        return df.selectExpr(*[z.get(c, f"`{c}`") for c in df.columns])


def impute_jointly(
    train: DataFrame, test: DataFrame, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Fill both sides with the medians of their union."""
    both = train.select(*columns).unionByName(test.select(*columns))
    imputer = MedianImputer(columns).fit(both)
    return imputer.transform(train), imputer.transform(test)
