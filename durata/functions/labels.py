"""Labels and censoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from durata.constants import EVENT, HORIZONS, TIME


def horizon_label(h: float, time: str = TIME, event: str = EVENT) -> Column:
    """1 when the hit was observed by ``h`` (inclusive), else 0."""
    return ((F.col(event) == 1) & (F.col(time) <= F.lit(float(h)))).cast("int")


def with_horizon_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({f"label_{h}h": horizon_label(h) for h in HORIZONS})


def scored_at(h: float, time: str = TIME, event: str = EVENT, boundary: str = "include") -> Column:
    """Rows whose status at ``h`` is known: not censored before it.

    A row censored exactly at ``h`` counts (``boundary="include"``) unless the stricter
    reading is asked for.
    """
    early = F.col(time) < F.lit(float(h))
    if boundary == "exclude":
        early = F.col(time) <= F.lit(float(h))
    return ~((F.col(event) == 0) & early)


def survival_pair(time: str = TIME, event: str = EVENT) -> Column:
    return F.struct(
        F.col(event).cast("boolean").alias("event"), F.col(time).cast("double").alias("time")
    )


def positive_time(time: str = TIME, floor: float = 1e-3) -> Column:
    return F.greatest(F.col(time).cast("double"), F.lit(floor))


def long_labels(df: DataFrame, id_col: str) -> DataFrame:
    """One row per subject and horizon with its label and inclusion flag."""
    horizons = F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon")
    x = df.select(id_col, TIME, EVENT, horizons)
    hit = (F.col(EVENT) == 1) & (F.col(TIME) <= F.col("horizon"))
    early = (F.col(EVENT) == 0) & (F.col(TIME) < F.col("horizon"))
    return x.select(id_col, "horizon", hit.cast("int").alias("label"), (~early).alias("scored"))
