"""Schemas, valid ranges, feature groups, horizons and weights.

These are contracts of the data and of the score, not choices of this library.
"""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StructField, StructType

ID = "event_id"
TIME = "time_to_hit_hours"
EVENT = "event"
META = (ID, TIME, EVENT)

# --- fixed values: horizons and the weighted Brier score ---
HORIZONS = (12, 24, 48, 72)
BRIER_WEIGHTS = {24: 0.3, 48: 0.4, 72: 0.3}
HYBRID_C_WEIGHT = 0.3
HYBRID_BRIER_WEIGHT = 0.7
PROB_COLS = [f"prob_{h}h" for h in HORIZONS]
SUBMISSION_COLUMNS = [ID, *PROB_COLS]

# --- fixed values: columns of the subject table by group ---
FEATURE_GROUPS: dict[str, list[str]] = {
    "temporal_coverage": [
        "num_perimeters_0_5h",
        "dt_first_last_0_5h",
        "low_temporal_resolution_0_5h",
    ],
    "growth": [
        "area_first_ha",
        "area_growth_abs_0_5h",
        "area_growth_rel_0_5h",
        "area_growth_rate_ha_per_h",
        "log1p_area_first",
        "log1p_growth",
        "log_area_ratio_0_5h",
        "relative_growth_0_5h",
        "radial_growth_m",
        "radial_growth_rate_m_per_h",
    ],
    "centroid_kinematics": [
        "centroid_displacement_m",
        "centroid_speed_m_per_h",
        "spread_bearing_deg",
        "spread_bearing_sin",
        "spread_bearing_cos",
    ],
    "distance": [
        "dist_min_ci_0_5h",
        "dist_std_ci_0_5h",
        "dist_change_ci_0_5h",
        "dist_slope_ci_0_5h",
        "closing_speed_m_per_h",
        "closing_speed_abs_m_per_h",
        "projected_advance_m",
        "dist_accel_m_per_h2",
        "dist_fit_r2_0_5h",
    ],
    "directionality": [
        "alignment_cos",
        "alignment_abs",
        "cross_track_component",
        "along_track_speed",
    ],
    "temporal_metadata": [
        "event_start_hour",
        "event_start_dayofweek",
        "event_start_month",
    ],
}

# --- fixed values: integer columns, every other feature is a double ---
LONG_COLUMNS = {
    ID,
    "num_perimeters_0_5h",
    "low_temporal_resolution_0_5h",
    "event_start_hour",
    "event_start_dayofweek",
    "event_start_month",
    EVENT,
}


def _field(name: str) -> StructField:
    return StructField(name, LongType() if name in LONG_COLUMNS else DoubleType())


TEST_SCHEMA = StructType(
    [_field(ID)] + [_field(c) for group in FEATURE_GROUPS.values() for c in group]
)
TRAIN_SCHEMA = StructType([*TEST_SCHEMA.fields, _field(TIME), _field(EVENT)])

# --- fixed values: closed valid intervals ---
VALID_RANGES: dict[str, tuple[float, float]] = {
    "event": (0, 1),
    "low_temporal_resolution_0_5h": (0, 1),
    "event_start_hour": (0, 23),
    "event_start_dayofweek": (0, 6),
    "event_start_month": (1, 12),
    "time_to_hit_hours": (0, 72),
    "alignment_cos": (-1, 1),
    "alignment_abs": (0, 1),
    "dist_fit_r2_0_5h": (0, 1),
}

# --- fixed values: redundant columns dropped from the feature table, and the pairs ---
REDUNDANT_COLUMNS = [
    "relative_growth_0_5h",
    "closing_speed_abs_m_per_h",
    "radial_growth_rate_m_per_h",
]
REDUNDANT_PAIRS = [
    ("area_growth_rel_0_5h", "relative_growth_0_5h"),
    ("closing_speed_m_per_h", "closing_speed_abs_m_per_h"),
    ("radial_growth_m", "radial_growth_rate_m_per_h"),
]

# --- fixed values: expected sign of the effect on the hit probability ---
MONOTONE_SIGNS: dict[str, int] = {
    "dist_min_ci_0_5h": -1,
    "dist_min_log": -1,
    "dist_change_ci_0_5h": -1,
    "dist_slope_ci_0_5h": -1,
    "projected_arrival_h": -1,
    "closing_speed_m_per_h": 1,
    "closing_speed_abs_m_per_h": 1,
    "projected_advance_m": 1,
    "advance_ratio": 1,
    "threat_score": 1,
    "alignment_x_speed": 1,
    "alignment_abs": 1,
    "area_first_ha": 1,
    "log1p_area_first": 1,
    "area_growth_rate_ha_per_h": 1,
    "radial_growth_m": 1,
    "growth_x_proximity": 1,
    "speed_x_growth": 1,
    "is_closing": 1,
    "is_growing": 1,
}

# --- fixed values: default search spaces of the tuner (kind, low, high) ---
SEARCH_SPACES: dict[str, dict[str, tuple[str, float, float]]] = {
    "gradient_boosted_survival": {
        "n_estimators": ("int", 80, 400),
        "learning_rate": ("log", 0.02, 0.25),
        "max_depth": ("int", 2, 5),
        "subsample": ("float", 0.6, 1.0),
        "min_samples_split": ("int", 2, 10),
        "min_samples_leaf": ("int", 1, 5),
    },
    "random_survival_forest": {
        "n_estimators": ("int", 100, 400),
        "max_depth": ("int", 3, 12),
        "min_samples_split": ("int", 2, 12),
        "min_samples_leaf": ("int", 1, 8),
    },
    "xgboost": {
        "n_estimators": ("int", 100, 600),
        "max_depth": ("int", 3, 8),
        "learning_rate": ("log", 0.02, 0.25),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.6, 1.0),
        "reg_lambda": ("log", 0.5, 10.0),
    },
}

# --- fixed values: seeds of the seed ensemble, drift and importance cut-offs ---
ENSEMBLE_SEEDS = (42, 123, 2024, 7, 99)
MI_THRESHOLD = 0.01
CORRELATION_THRESHOLD = 0.95
PSI_ALERT = 0.2
