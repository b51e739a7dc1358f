"""Engineered features as one fused projection.

``dist_bin`` is the only feature that needs a pass over the data (its tercile edges);
``fit_quantile_bins`` returns those edges so they can be frozen on the training split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from durata.constants import REDUNDANT_COLUMNS
from durata.functions.columns import clip, nn
from durata.operators.quantiles import exact_quantiles

GEOSPATIAL_FEATURES = [
    "threat_score", "projected_arrival_h", "is_closing", "dist_min_log", "dist_bin",
    "advance_ratio", "alignment_x_speed", "is_growing", "growth_x_proximity", "speed_x_growth",
]
TEMPORAL_FEATURES = [
    "hour_sin", "hour_cos", "month_sin", "month_cos", "is_daytime", "is_weekend",
]


def _flag(condition: Column) -> Column:
    """0/1 long; a missing operand counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("long")


def quantile_bin(c: str | Column, edges: list[float]) -> Column:
    """Index of the right-closed bin, lowest edge included; null outside or missing."""
    x = nn(c)
    if len(edges) < 2:
        return F.lit(None).cast("long")
    inner = [(x > F.lit(e)).cast("long") for e in edges[1:-1]]
    idx = sum(inner, F.lit(0).cast("long"))
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(inside, idx)


def fit_quantile_bins(df: DataFrame, column: str, q: int) -> list[float]:
    """Distinct linear-interpolation quantile edges at 0, 1/q, ..., 1."""
    edges = exact_quantiles(df, {column: nn(column)}, [i / q for i in range(q + 1)])[column]
    return sorted({e for e in edges if e is not None})


def geospatial_columns(dist_edges: list[float]) -> dict[str, Column]:
    dist, speed = nn("dist_min_ci_0_5h"), nn("closing_speed_m_per_h")
    rate, advance = nn("area_growth_rate_ha_per_h"), nn("projected_advance_m")
    near = dist + F.lit(1.0)
    return {
        "threat_score": F.try_divide(speed, near),
        "projected_arrival_h": F.when(
            dist.isNotNull() & speed.isNotNull(),
            clip(dist / F.greatest(speed, F.lit(1.0)), 0, 200),
        ),
        "is_closing": _flag(speed > 0),
        "dist_min_log": F.log1p(dist),
        "dist_bin": quantile_bin("dist_min_ci_0_5h", dist_edges),
        "advance_ratio": F.try_divide(advance, near),
        "alignment_x_speed": nn("alignment_abs") * speed,
        "is_growing": _flag(nn("area_growth_abs_0_5h") > 0),
        "growth_x_proximity": F.try_divide(rate, near),
        "speed_x_growth": speed * rate,
    }


def temporal_columns() -> dict[str, Column]:
    hour, month = F.col("event_start_hour"), F.col("event_start_month")
    day_angle, year_angle = hour * (2 * math.pi / 24), month * (2 * math.pi / 12)
    return {
        "hour_sin": F.sin(day_angle),
        "hour_cos": F.cos(day_angle),
        "month_sin": F.sin(year_angle),
        "month_cos": F.cos(year_angle),
        "is_daytime": _flag((hour >= 6) & (hour < 20)),
        "is_weekend": _flag(F.col("event_start_dayofweek") >= 5),
    }


def compute_geospatial_features(df: DataFrame, dist_edges: list[float] | None = None) -> DataFrame:
    edges = dist_edges if dist_edges is not None else fit_quantile_bins(df, "dist_min_ci_0_5h", 3)
    return df.withColumns(geospatial_columns(edges))


def compute_temporal_features(df: DataFrame) -> DataFrame:
    return df.withColumns(temporal_columns())


def engineer_features(df: DataFrame, dist_edges: list[float] | None = None) -> DataFrame:
    """Base columns plus all engineered ones, redundant columns dropped.

    Without ``dist_edges`` the bins are taken from ``df`` itself.
    """
    edges = dist_edges if dist_edges is not None else fit_quantile_bins(df, "dist_min_ci_0_5h", 3)
    wide = df.withColumns({**geospatial_columns(edges), **temporal_columns()})
    return wide.drop(*REDUNDANT_COLUMNS)
