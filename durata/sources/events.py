"""Subject tables built from an event log: time to a user's next ``error``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from durata.constants import EVENT, HORIZONS, ID, TIME

FEATURES = [
    "dist_min_ci_0_5h", "closing_speed_m_per_h", "closing_speed_abs_m_per_h",
    "projected_advance_m", "alignment_abs", "alignment_cos", "area_growth_abs_0_5h",
    "area_growth_rate_ha_per_h", "event_start_hour", "event_start_dayofweek",
    "event_start_month", "low_temporal_resolution_0_5h",
]


def next_error(events: DataFrame) -> DataFrame:
    """Each event with the time of the same user's next later error.

    A user may own a large share of the log, so no window covers a whole user: it runs
    inside (user, hour), and a second one over the per-hour first errors of the user
    supplies the answer for rows with no later error in their own hour.
    """
    hours = events.withColumn("hour_start", F.date_trunc("hour", "ts"))
    error_ts = F.when(F.col("event_type") == "error", F.col("ts"))
    inside = (
        Window.partitionBy("user_id", "hour_start")
        .orderBy(F.col("ts").desc(), F.col("event_id").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first_errors = hours.groupBy("user_id", "hour_start").agg(F.min(error_ts).alias("first_error"))
    later_hours = (
        Window.partitionBy("user_id")
        .orderBy(F.col("hour_start").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    later = first_errors.select(
        "user_id", "hour_start", F.min("first_error").over(later_hours).alias("later_error")
    )
    return (
        hours.withColumn("same_hour", F.min(error_ts).over(inside))
        .join(later, ["user_id", "hour_start"])
        .withColumn("next_ts", F.coalesce("same_hour", "later_error"))
        .drop("same_hour", "later_error", "hour_start")
    )


def _features(k: Column) -> dict[str, Column]:
    growth = F.greatest(k - 75, F.lit(0))
    return {
        "dist_min_ci_0_5h": F.col("value") * 100,
        "closing_speed_m_per_h": (k - 50) * 10.0,
        "closing_speed_abs_m_per_h": F.abs((k - 50) * 10.0),
        "projected_advance_m": (k - 50) * 50.0,
        "alignment_abs": k / 99.0,
        "alignment_cos": k / 49.5 - 1,
        "area_growth_abs_0_5h": growth * 1.0,
        "area_growth_rate_ha_per_h": growth / 5.0,
        "event_start_hour": F.hour("ts").cast("long"),
        "event_start_dayofweek": F.weekday("ts").cast("long"),
        "event_start_month": F.month("ts").cast("long"),
        "low_temporal_resolution_0_5h": (F.col("event_type") == "view").cast("long"),
    }


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def elapsed_micros(interval: Column) -> Column:
    """Microseconds of a day-time interval, free of any session time zone."""
    part = lambda unit: F.extract(F.lit(unit), interval)
    whole = part("DAY") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60
    return whole.cast("long") * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One right-censored subject per event, with durations and feature columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    end_ts = events.agg(F.max("ts")).scalar()
    hours = elapsed_micros(F.coalesce("next_ts", end_ts) - F.col("ts")) / 3.6e9
    timed = next_error(events).withColumn("h", hours).withColumn("k", _k())
    return timed.select(
        ID,
        "user_id",
        "event_type",
        "ts",
        "k",
        "value",
        F.least("h", F.lit(72.0)).alias(TIME),
        (F.col("next_ts").isNotNull() & (F.col("h") <= 72)).cast("long").alias(EVENT),
        *[e.alias(n) for n, e in _features(F.col("k")).items()],
    )


def features_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature columns without the durations (no window, no shuffle)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", _k())
    return events.select(ID, "user_id", *[e.alias(n) for n, e in _features(F.col("k")).items()])


def hash_uniform(column: str, salt: str) -> Column:
    """Deterministic uniform in (0, 1) from the id."""
    digits = F.substring(F.md5(F.concat_ws("|", F.col(column).cast("string"), F.lit(salt))), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**32))


def planted_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows, with a duration driven by distance, speed and growth.

    An exponential time whose log rate is linear in three features, censored by an
    independent uniform time and at 72 h; everything follows from the id and features.
    """
    df = features_only(spark, sf_dir)
    log_rate = (
        F.lit(-3.6)
        - F.lit(0.9) * (F.log1p("dist_min_ci_0_5h") - 7.0)
        + F.lit(0.004) * F.col("closing_speed_m_per_h")
        + F.lit(0.15) * F.col("area_growth_rate_ha_per_h")
    )
    hit_at = -F.ln(hash_uniform(ID, "hit")) / F.exp(log_rate)
    censor_at = F.least(F.lit(20.0) + hash_uniform(ID, "censor") * 120.0, F.lit(72.0))
    return df.withColumns(
        {TIME: F.least(hit_at, censor_at), EVENT: (hit_at <= censor_at).cast("long")}
    )


def with_probabilities(df: DataFrame, offset: Column | float = 20.0, by: str = "k") -> DataFrame:
    """Closed-form probabilities 1 - exp(-h / (offset + column))."""
    scale = F.lit(offset) + F.col(by)
    return df.withColumns({f"prob_{h}h": 1 - F.exp(F.lit(-float(h)) / scale) for h in HORIZONS})


def member_predictions(df: DataFrame) -> DataFrame:
    """Three prediction sets in long form (model column); the third is not monotone."""
    base = df.select(ID, TIME, EVENT, "k", "value")
    a = with_probabilities(base, 20.0, "k").withColumn("model", F.lit("a"))
    b = with_probabilities(base, 10.0, "value").withColumn("model", F.lit("b"))
    c = a.withColumns(
        {"prob_24h": F.col("prob_48h"), "prob_48h": F.col("prob_24h"), "model": F.lit("c")}
    )
    cols = [ID, "model", TIME, EVENT, *[f"prob_{h}h" for h in HORIZONS]]
    return a.select(cols).unionByName(b.select(cols)).unionByName(c.select(cols))


def train_split(df: DataFrame) -> DataFrame:
    return df.filter(F.col("user_id") % 10 < 7)


def test_split(df: DataFrame) -> DataFrame:
    return df.filter(F.col("user_id") % 10 >= 7)


