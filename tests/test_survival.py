import math
import random

import pytest
from pyspark.sql import functions as F

from durata.operators import survival as S
from durata.operators.scan import equi_depth_splits, prefix_sums, with_bucket
from durata.sources.events import next_error


def subjects(spark, seed=1, n=160):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice("ab"), float(rng.choice([72.0, 72.0, rng.randint(0, 9), rng.random() * 70])), rng.randint(0, 1), rng.random())
        for i in range(n)
    ]
    cols = "event_id long, g string, time_to_hit_hours double, event long, x double"
    return rows, spark.createDataFrame(rows, cols)


def brute_km(rows, t):
    s = 1.0
    for u in sorted({r[2] for r in rows if r[2] <= t}):
        n = sum(r[2] >= u for r in rows)
        d = sum(r[2] == u and r[3] == 1 for r in rows)
        s *= 1 - d / n
    return s


def test_km_horizons_against_brute_force(spark):
    rows, df = subjects(spark)
    got = {r["g"]: r for r in S.km_horizons(df, ["g"]).collect()}
    for g in "ab":
        part = [r for r in rows if r[1] == g]
        assert got[g]["n"] == len(part)
        for h in (12, 24, 48, 72):
            assert got[g][f"prob_{h}h"] == pytest.approx(1 - brute_km(part, h))


def test_curve_band_hazard_and_steps(spark):
    rows, df = subjects(spark, 2)
    curve = S.km_curve(df)
    for r in curve.collect():
        assert r["survival"] == pytest.approx(brute_km(rows, r["time"]))
        if r["survival_lower"] is not None:
            assert 0 <= r["survival_lower"] <= r["survival"] <= r["survival_upper"] <= 1
    step = S.step_at(curve, (24, 500)).first()
    assert step["survival_24h"] == pytest.approx(brute_km(rows, 24))
    assert step["survival_500h"] == pytest.approx(brute_km(rows, 72))
    assert S.nearest_step(curve, 72).first()[0] == pytest.approx(brute_km(rows, 72))


def test_everyone_hit_ends_at_zero(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, 5.0, 1)], "event_id long, time_to_hit_hours double, event long")
    assert [r["survival"] for r in S.km_curve(df).orderBy("time").collect()] == [0.5, 0.0]
    assert S.km_horizons(df).first()["prob_12h"] == 1.0
    assert S.step_on_grid(df, points=73).filter("cell = 5").first()["incidence"] == 1.0


def brute_logrank(rows, side):
    oe = var = 0.0
    for u in sorted({r[2] for r in rows}):
        risk = [r for r in rows if r[2] >= u]
        n, na = len(risk), sum(side(r) for r in risk)
        d = sum(r[2] == u and r[3] == 1 for r in rows)
        da = sum(r[2] == u and r[3] == 1 and side(r) for r in rows)
        oe += da - d * na / n
        if n > 1:
            var += d * (na / n) * (1 - na / n) * (n - d) / (n - 1)
    return oe * oe / var


def test_logrank_against_brute_force(spark):
    rows, df = subjects(spark, 3)
    got = S.with_pvalue(S.logrank(df, {"g": F.col("g") == "a", "x": F.col("x") < 0.3})).collect()
    got = {r["test"]: r for r in got}
    for name, side in (("g", lambda r: r[1] == "a"), ("x", lambda r: r[4] < 0.3)):
        want = brute_logrank(rows, side)
        assert got[name]["test_statistic"] == pytest.approx(want)
        assert got[name]["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)))


def test_logrank_scan_skips_small_sides(spark):
    _, df = subjects(spark, 4)
    df = df.withColumns({"rare": (F.col("event_id") < 3).cast("double"), "k": F.lit(1.0)})
    assert {r["test"] for r in S.logrank_scan(df, ["x", "rare", "k"]).collect()} == {"x"}


def test_stratified_fallback_on_ties(spark):
    _, df = subjects(spark, 5)
    tied = df.withColumn("x", F.when(F.col("x") > 0.9, F.lit(2.0)).otherwise(F.lit(1.0)))
    assert {r["group"] for r in S.stratified_km(tied, "x", 4).collect()} == {"Low", "High"}
    assert {r["group"] for r in S.stratified_km(df, "x", 3).collect()} == {"Q1", "Q2", "Q3"}
    assert S.stratified_logrank(df, "x", 3).count() == 1


def test_prefix_sums_many_buckets(spark):
    rng = random.Random(9)
    data = [(g, t, rng.randint(0, 5)) for g in "xy" for t in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(data, "g string, t int, v long").withColumn("t", F.col("t").cast("double"))
    bucketed = with_bucket(df, "t", equi_depth_splits(df, "t", 20))
    up = prefix_sums(bucketed, ["g"], "t", {"s": "v"}, inclusive=False).collect()
    down = prefix_sums(bucketed, ["g"], "t", {"s": "v"}, reverse=True).collect()
    for r in up:
        assert r["s"] == sum(v for g, t, v in data if g == r["g"] and t < r["t"])
    for r in down:
        assert r["s"] == sum(v for g, t, v in data if g == r["g"] and t >= r["t"])


def test_next_error_with_one_dominant_user(spark):
    rng = random.Random(4)
    rows = [
        (i, rng.choice([1, 1, 1, 2]), rng.randint(0, 400_000), rng.choice(["error", "view", "view"]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    got = {r["event_id"]: r["next_s"] for r in next_error(df).select("event_id", F.unix_timestamp("next_ts").alias("next_s")).collect()}
    for i, u, s, _ in rows:
        later = [(b, j) for j, v, b, t in rows if v == u and t == "error" and (b, j) > (s, i)]
        assert got[i] == (min(later)[0] if later else None)
