import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from durata.constants import FEATURE_GROUPS, TEST_SCHEMA, TRAIN_SCHEMA
from durata.functions import features as FE
from durata.functions.columns import enforce_monotonicity, factorize, nn, recode
from durata.operators import quality as Q
from durata.operators.quantiles import exact_quantiles
from durata.operators.resample import repeated_folds, stratified_folds, stratified_holdout
from durata.operators.stats import correlated_pairs, correlation_matrix

SCHEMA = StructType([StructField("a", LongType()), StructField("b", DoubleType())])


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.9)], SCHEMA)


def test_schema_counts():
    assert len(TRAIN_SCHEMA) == 37 and len(TEST_SCHEMA) == 35
    assert sum(len(v) for v in FEATURE_GROUPS.values()) == 34


def test_schema_check(spark, small):
    assert Q.validate_schema(small, SCHEMA)
    assert Q.validate_schema(small.withColumn("x", F.lit(1)), SCHEMA)  # extra only warns
    assert not Q.validate_schema(small.drop("b"), SCHEMA)
    assert not Q.validate_schema(small.withColumn("a", F.col("a").cast("double")), SCHEMA)


def test_dataset_checks_name_the_failures(small):
    Q.validate_dataset(small, SCHEMA, ["a", "b"], {"b": (0, 1)}, 3)
    with pytest.raises(ValueError, match="ranges, row_count"):
        Q.validate_dataset(small, SCHEMA, ["a", "b"], {"b": (0, 0.6)}, 30)
    holes = small.withColumn("b", F.when(F.col("a") > 1, F.col("b")).otherwise(F.lit(float("nan"))))
    with pytest.raises(ValueError, match="nulls"):
        Q.validate_dataset(holes, SCHEMA, ["a", "b"], {"b": (0, 1)}, 3)


def test_row_count_tolerance():
    assert Q.row_count_ok(100, 100) and Q.row_count_ok(101, 100) and Q.row_count_ok(5, 0)
    assert not Q.row_count_ok(102, 100)


def features_frame(spark):
    cols = (
        "event_id long, dist_min_ci_0_5h double, closing_speed_m_per_h double, projected_advance_m double, "
        "alignment_abs double, area_growth_abs_0_5h double, area_growth_rate_ha_per_h double, "
        "event_start_hour long, event_start_month long, event_start_dayofweek long"
    )
    rows = [
        (1, 1000.0, 50.0, 100.0, 0.5, 1.0, 0.2, 14, 6, 0),
        (2, 0.0, -20.0, -10.0, 0.1, 0.0, 0.0, 3, 7, 5),
        (3, 90000.0, 0.0, 0.0, 0.9, -1.0, -0.1, 10, 8, 2),
        (4, 500.0, 900.0, 450.0, 1.0, 10.0, 2.0, 22, 1, 6),
        (5, None, None, None, None, None, None, 7, 12, 4),
    ]
    return spark.createDataFrame(rows, cols)


def test_engineered_values(spark):
    out = FE.engineer_features(features_frame(spark))
    rows = {r["event_id"]: r for r in out.collect()}
    assert [rows[i]["is_daytime"] for i in range(1, 6)] == [1, 0, 1, 0, 1]
    assert [rows[i]["is_weekend"] for i in range(1, 6)] == [0, 1, 0, 1, 0]
    assert rows[1]["threat_score"] == pytest.approx(50 / 1001)
    assert rows[1]["projected_arrival_h"] == pytest.approx(20)
    assert rows[3]["projected_arrival_h"] == 200  # clipped
    assert rows[2]["is_closing"] == 0 and rows[1]["is_closing"] == 1
    assert rows[5]["is_closing"] == 0 and rows[5]["threat_score"] is None
    assert sorted({rows[i]["dist_bin"] for i in range(1, 5)}) == [0, 1, 2]
    assert rows[4]["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 22 / 24))
    assert len(FE.GEOSPATIAL_FEATURES) + len(FE.TEMPORAL_FEATURES) == 16


def test_full_feature_table_has_47_features(spark):
    row = spark.range(3).select(
        *[(F.col("id") + i).cast(f.dataType).alias(f.name) for i, f in enumerate(TRAIN_SCHEMA.fields)]
    )
    out = FE.engineer_features(row)
    assert len([c for c in out.columns if c not in ("event_id", "time_to_hit_hours", "event")]) == 47


def test_monotone_repair(spark):
    cols = "prob_12h double, prob_24h double, prob_48h double, prob_72h double"
    df = spark.createDataFrame([(0.9, 0.3, 0.5, 0.7), (-0.1, 0.2, 1.4, 0.3), (0.1, None, 0.5, 0.6)], cols)
    a, b, c = enforce_monotonicity(df).collect()
    assert tuple(a) == (0.9, 0.9, 0.9, 0.9)
    assert tuple(b) == (0.0, 0.2, 1.0, 1.0)
    assert tuple(c) == (0.1, None, None, None)


def test_recode_and_factorize(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (0, "a")], "e int, s string")
    assert [r[0] for r in df.select(recode("e", {0: "cens", 1: "hit"})).collect()] == ["cens", "hit", "cens"]
    assert [r["s"] for r in factorize(df).collect()] == [1, -1, 0]


def reference_quantile(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


def test_exact_quantiles_without_gathering(spark):
    """Forced narrowing (tiny limit) on smooth, tied and two-valued columns."""
    rng = random.Random(11)
    rows = [
        (rng.gauss(0, 1), float(rng.choice([1, 1, 1, 5, 9])), float(i % 2), 7.0 if i % 3 else rng.random())
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {c: nn(c) for c in "abcd"}, probs, small=25)
    for j, c in enumerate("abcd"):
        want = [reference_quantile([r[j] for r in rows], p) for p in probs]
        assert got[c] == pytest.approx(want, abs=1e-12)
    assert exact_quantiles(df.filter("a > 100"), {"a": nn("a")}, [0.5])["a"] == [None]


def test_submission_contract(spark):
    cols = "event_id long, prob_12h double, prob_24h double, prob_48h double, prob_72h double"
    good = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4), (2, 0.0, 0.0, 1.0, 1.0)], cols)
    ids = good.select("event_id")
    Q.validate_submission(good, ids)
    with pytest.raises(ValueError, match="Expected columns"):
        Q.validate_submission(good.drop("prob_12h"))
    with pytest.raises(ValueError, match="null"):
        Q.validate_submission(good.withColumn("prob_24h", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="outside"):
        Q.validate_submission(good.withColumn("prob_72h", F.lit(1.2)))
    with pytest.raises(ValueError, match="Monotonicity"):
        Q.validate_submission(good.withColumn("prob_48h", F.lit(0.0)))
    with pytest.raises(ValueError, match="rows"):
        Q.validate_submission(good.limit(1), ids)
    moved = good.withColumn("event_id", F.col("event_id") + 1)
    with pytest.raises(ValueError, match="ids"):
        Q.validate_submission(moved, ids)


def test_correlated_pair_and_constant_column(spark):
    df = spark.range(200).selectExpr("id * 1.0D as a", "id * -2.0D + 1 as b", "pmod(hash(id), 7) * 1D as c", "5.0D as k")
    pairs = [tuple(r) for r in correlated_pairs(df, ["a", "b", "c", "k"]).collect()]
    assert pairs == [("a", "b", 1.0)]
    r = {(x[0], x[1]): x[2] for x in correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert r["a", "b"] == pytest.approx(-1) and r["a", "k"] is None and r["a", "a"] == pytest.approx(1)


def test_folds_are_balanced_and_repeatable(spark):
    df = spark.range(1003).select(F.col("id").alias("event_id"), (F.col("id") % 3 == 0).cast("long").alias("event"))
    sizes = stratified_folds(df, 5, 7).groupBy("event", "fold").count().collect()
    for e in (0, 1):
        counts = [r["count"] for r in sizes if r["event"] == e]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    again = stratified_folds(df.repartition(3), 5, 7)
    assert stratified_folds(df, 5, 7).exceptAll(again).count() == 0
    assert repeated_folds(df, 3, 2).select("repeat", "fold").distinct().count() == 6
    held = stratified_holdout(df, 0.25).groupBy("event").agg(F.count_if("holdout"), F.count("*")).collect()
    assert all(abs(r[1] - 0.25 * r[2]) <= 0.5 for r in held)


def test_drift_of_identical_and_moved_columns(spark):
    df = spark.range(5000).selectExpr("pmod(hash(id), 1000) * 1.0D as x", "pmod(hash(id), 4) as g")
    same = Q.psi(df, df, ["x"]).first()
    assert same["psi"] == pytest.approx(0) and not same["alert"]
    moved = Q.psi(df, df.withColumn("x", F.col("x") + 400), ["x"]).first()
    assert moved["alert"]
    chi = Q.chi_square_drift(df, df, ["g"]).withColumn("p", Q.chi2_pvalue("chi_square", "dof")).first()
    assert chi["chi_square"] == pytest.approx(0) and chi["p"] == pytest.approx(1) and chi["dof"] == 3


def test_chi2_tail_known_values():
    assert Q._upper_gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert Q._upper_gamma_q(2.5, 11.070497693516351 / 2) == pytest.approx(0.05, abs=1e-9)
