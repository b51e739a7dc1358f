"""Registered queries: each takes (spark, table folder) and returns a DataFrame.

The subject table is derived from the whole event log once per session and folder and
persisted, as the processed table of a pipeline would be; every query reads all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from durata.constants import EVENT, ID, PROB_COLS, TIME, VALID_RANGES
from durata.functions import features as FE
from durata.functions.columns import enforce_monotonicity, significance_stars
from durata.functions.labels import long_labels
from durata.operators import errors as ER
from durata.operators import metrics as ME
from durata.operators import quality as QU
from durata.operators import resample as RE
from durata.operators import selection as SE
from durata.operators import stats as ST
from durata.operators import survival as SU
from durata.operators.concordance import concordance
from durata.operators.ensemble import weighted_average
from durata.sources import events as EV

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_cache: dict[tuple[str, str, str], DataFrame] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def shared(name: str, spark: SparkSession, sf_dir: str, build: Query) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cache:
        _cache[key] = build(spark, sf_dir).persist()
    return _cache[key]


def subject_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared("subjects", spark, sf_dir, EV.subjects)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.member_predictions(subject_table(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.with_probabilities(subject_table(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for engine-independent comparison (-0.0 becomes 0.0)."""
    cols = [
        f"round(`{c}`, {digits}) + 0D as `{c}`" if t in ("double", "float") else f"`{c}`"
        for c, t in df.dtypes
    ]
    return df.selectExpr(*cols)


# --- features ---------------------------------------------------------------------------


@query
def features_geospatial(spark, d):
    out = FE.compute_geospatial_features(EV.features_only(spark, d))
    return rounded(out.select(ID, *FE.GEOSPATIAL_FEATURES))


@query
def features_temporal(spark, d):
    out = FE.compute_temporal_features(EV.features_only(spark, d))
    return rounded(out.select(ID, *FE.TEMPORAL_FEATURES))


@query
def features_full(spark, d):
    """Per-split engineering: train and test each use their own bin edges."""
    both = EV.features_only(spark, d)
    parts = [FE.engineer_features(split(both)) for split in (EV.train_split, EV.test_split)]
    out = parts[0].unionByName(parts[1])
    return rounded(out.drop("user_id"))


@query
def quantile_bins(spark, d):
    """Tercile edges frozen on the training split, applied to every row."""
    df = EV.features_only(spark, d)
    edges = FE.fit_quantile_bins(EV.train_split(df), "dist_min_ci_0_5h", 3)
    counted = df.select(FE.quantile_bin("dist_min_ci_0_5h", edges).alias("bin"))
    return counted.groupBy("bin").agg(F.count("*").alias("n"))


@query
def horizon_labels(spark, d):
    rows = long_labels(subject_table(spark, d), ID)
    return rows.groupBy("horizon").agg(
        F.sum("label").alias("positives"), F.count_if("scored").alias("scored")
    )


# --- data quality -----------------------------------------------------------------------

SUBJECT_COLUMNS = [ID, *EV.FEATURES, TIME, EVENT]
CONTINUOUS = [
    "dist_min_ci_0_5h", "closing_speed_m_per_h", "projected_advance_m", "alignment_abs",
    "alignment_cos", "area_growth_abs_0_5h", "area_growth_rate_ha_per_h",
]


def with_holes(df: DataFrame) -> DataFrame:
    """Nulls and NaN planted in two columns, for the missing-value checks."""
    return df.withColumns(
        {
            "dist_min_ci_0_5h": F.when(F.col(ID) % 97 != 0, F.col("dist_min_ci_0_5h")),
            "alignment_abs": F.when(F.col(ID) % 89 == 0, F.lit(float("nan"))).otherwise(
                F.col("alignment_abs")
            ),
        }
    )


@query
def validate_nulls(spark, d):
    return QU.null_report(with_holes(subject_table(spark, d)), SUBJECT_COLUMNS)


@query
def validate_ranges(spark, d):
    tight = {**VALID_RANGES, "dist_min_ci_0_5h": (100.0, 9000.0), "alignment_abs": (0.05, 0.9)}
    return rounded(QU.range_report(with_holes(subject_table(spark, d)), tight))


def event_count(spark: SparkSession, d: str) -> int:
    """Rows that the subject table must have: those of the event log."""
    return spark.read.parquet(f"{d}/events.parquet").count()


@query
def validate_row_count(spark, d):
    """The count check on the whole table and on one that lost a fortieth of its rows."""
    df = subject_table(spark, d)
    n = df.agg(F.count("*").alias("whole"), F.count_if(F.col(ID) % 40 != 0).alias("short")).unpivot(
        [], ["whole", "short"], "table", "actual"
    )
    expected = event_count(spark, d)
    return n.select(
        "table", "actual", F.lit(expected).cast("long").alias("expected"),
        QU.row_count_ok(F.col("actual"), expected).alias("passed"),
    )


@query
def validate_all(spark, d):
    return QU.check_dataset(
        with_holes(subject_table(spark, d)), SUBJECT_COLUMNS, VALID_RANGES, event_count(spark, d)
    )


@query
def submission_contract(spark, d):
    df = members(spark, d).filter("model = 'c'").select(ID, *PROB_COLS)
    return QU.submission_report(df, subject_table(spark, d).select(ID))


@query
def profile(spark, d):
    return rounded(QU.profile(with_holes(subject_table(spark, d)), [*EV.FEATURES, TIME, EVENT]))


@query
def monitoring_profile(spark, d):
    df = subject_table(spark, d)
    base = QU.profile(EV.train_split(df), CONTINUOUS)
    out = QU.monitoring_profile(EV.test_split(df), CONTINUOUS, base)
    return rounded(out.select("column", "outliers", "mean", "baseline_mean", "mean_shift_std"))


@query
def zero_fraction(spark, d):
    return rounded(QU.zero_fraction(subject_table(spark, d), EV.FEATURES))


@query
def negative_counts(spark, d):
    return rounded(QU.negative_counts(subject_table(spark, d), EV.FEATURES))


@query
def null_totals(spark, d):
    return QU.null_totals(with_holes(subject_table(spark, d)).select(*SUBJECT_COLUMNS))


@query
def duplicate_rows(spark, d):
    return QU.duplicate_rows(
        EV.features_only(spark, d).select("event_start_hour", "alignment_abs", "dist_min_ci_0_5h")
    )


@query
def histograms(spark, d):
    return rounded(QU.histogram(subject_table(spark, d), [*CONTINUOUS, TIME], 20, [EVENT]))


@query
def split_histograms(spark, d):
    df = subject_table(spark, d).withColumn(
        "split", F.when(F.col("user_id") % 10 < 7, "train").otherwise("test")
    )
    return rounded(QU.histogram(df, CONTINUOUS, 30, ["split"]))


@query
def psi(spark, d):
    df = subject_table(spark, d)
    return rounded(QU.psi(EV.train_split(df), EV.test_split(df), CONTINUOUS))


@query
def chi_square_drift(spark, d):
    df = subject_table(spark, d)
    discrete = ["event_start_hour", "event_start_dayofweek", "low_temporal_resolution_0_5h"]
    return rounded(QU.chi_square_drift(EV.train_split(df), EV.test_split(df), discrete))


# --- aggregations -----------------------------------------------------------------------


@query
def horizon_counts(spark, d):
    return rounded(ST.horizon_counts(subject_table(spark, d)))


@query
def censoring_rate(spark, d):
    return rounded(ST.censoring_summary(subject_table(spark, d)))


@query
def target_stats(spark, d):
    return rounded(ST.target_stats(subject_table(spark, d)))


@query
def describe_by_event(spark, d):
    return rounded(ST.describe_by(subject_table(spark, d), EVENT, CONTINUOUS))


@query
def hit_rate_by_weekday(spark, d):
    return rounded(ST.hit_rate_by(subject_table(spark, d), "event_start_dayofweek"))


@query
def hit_rate_by_month(spark, d):
    return rounded(ST.hit_rate_by(subject_table(spark, d), "event_start_month"))


@query
def binary_flag_rates(spark, d):
    df = FE.compute_temporal_features(subject_table(spark, d))
    return rounded(ST.flag_rates(df, ["low_temporal_resolution_0_5h", "is_daytime", "is_weekend"]))


@query
def quantile_band_rates(spark, d):
    return rounded(ST.band_rates(subject_table(spark, d), "dist_min_ci_0_5h", 4))


@query
def feature_moments(spark, d):
    return rounded(ST.feature_moments(subject_table(spark, d), EV.FEATURES))


@query
def censored_quantiles(spark, d):
    return rounded(ST.subset_quantile(subject_table(spark, d), F.col(EVENT) == 0))


@query
def event_timeline(spark, d):
    return rounded(ST.event_timeline(subject_table(spark, d), ID))


@query
def correlation_matrix(spark, d):
    cols = [c for c in EV.FEATURES if c != "event_start_month"]
    return rounded(ST.correlation_matrix(subject_table(spark, d), cols))


@query
def correlated_pairs(spark, d):
    cols = [c for c in EV.FEATURES if c != "event_start_month"]
    return ST.correlated_pairs(subject_table(spark, d), cols, 0.85)


@query
def target_correlation(spark, d):
    cols = [c for c in EV.FEATURES if c != "event_start_month"]
    return rounded(ST.target_correlation(subject_table(spark, d), cols, TIME))


@query
def event_correlation(spark, d):
    cols = [c for c in EV.FEATURES if c != "event_start_month"]
    return rounded(ST.target_correlation(subject_table(spark, d), cols, EVENT))


# --- survival ---------------------------------------------------------------------------


@query
def km_curve(spark, d):
    out = SU.km_curve(subject_table(spark, d))
    return rounded(out.select("time", "n", "d", "c", "survival"))


@query
def km_horizons(spark, d):
    return rounded(SU.km_horizons(subject_table(spark, d)))


@query
def km_by_group(spark, d):
    return rounded(SU.km_horizons(subject_table(spark, d), ["event_type"]))


@query
def km_band(spark, d):
    out = SU.km_curve(subject_table(spark, d), ["event_type"])
    return rounded(out.select("event_type", "time", "survival_lower", "survival_upper"))


@query
def km_stratified(spark, d):
    return rounded(SU.stratified_km(subject_table(spark, d), "dist_min_ci_0_5h", 3))


@query
def km_by_flag(spark, d):
    return rounded(SU.km_horizons(subject_table(spark, d), ["low_temporal_resolution_0_5h"]))


@query
def cumulative_incidence_grid(spark, d):
    return rounded(SU.step_on_grid(subject_table(spark, d)).select("cell", "time", "incidence"))


@query
def nelson_aalen(spark, d):
    out = SU.km_curve(subject_table(spark, d))
    return rounded(out.select("time", "hazard", "hazard_var", "hazard_lower", "hazard_upper"))


@query
def survival_at_clamped_times(spark, d):
    curve = SU.km_curve(subject_table(spark, d), ["event_type"])
    return rounded(SU.step_at(curve, (12, 24, 48, 72, 96), ["event_type"]))


@query
def logrank_two_group(spark, d):
    df = subject_table(spark, d)
    return rounded(SU.logrank(df, {"low_resolution": F.col("low_temporal_resolution_0_5h") == 1}), 5)


@query
def logrank_stratified(spark, d):
    """Lowest against highest distance tercile."""
    return rounded(SU.stratified_logrank(subject_table(spark, d), "dist_min_ci_0_5h", 3), 5)


@query
def logrank_scan(spark, d):
    return rounded(SU.logrank_scan(subject_table(spark, d), EV.FEATURES), 4)


@query
def logrank_pvalues(spark, d):
    out = SU.with_pvalue(SU.logrank_scan(subject_table(spark, d), EV.FEATURES))
    return rounded(out.select("test", "test_statistic", "p_value", "stars", "significant"), 4)


# --- metrics ----------------------------------------------------------------------------


@query
def brier_censor_aware(spark, d):
    return rounded(
        members(spark, d).groupBy("model").agg(
            *[ME.brier_censor_aware(h).alias(f"brier_{h}h_ca") for h in (12, 24, 48, 72)]
        )
    )


@query
def weighted_brier(spark, d):
    return rounded(ME.weighted_brier(members(spark, d), ["model"]))


@query
def brier_naive(spark, d):
    out = ME.core_scores(members(spark, d), ["model"])
    return rounded(out.select("model", *[f"brier_{h}h_naive" for h in (12, 24, 48, 72)], "brier_mean"))


@query
def log_loss(spark, d):
    out = ME.core_scores(members(spark, d), ["model"])
    return rounded(out.select("model", *[f"logloss_{h}h" for h in (12, 24, 48, 72)]))


@query
def auc(spark, d):
    return rounded(ME.auc(members(spark, d), ["model"]))


@query
def c_index(spark, d):
    return rounded(concordance(members(spark, d), ["model"]))


@query
def hybrid_score(spark, d):
    return rounded(ME.hybrid_score(predicted(spark, d)))


@query
def calibration_curve(spark, d):
    return rounded(ME.calibration_curve(members(spark, d), ["model"]))


@query
def calibration_gap(spark, d):
    curve = ME.calibration_curve(members(spark, d), ["model"])
    return rounded(ME.calibration_gap(curve, ["model"]))


@query
def all_metrics(spark, d):
    return rounded(ME.all_metrics(members(spark, d), ["model"]))


@query
def hard_predictions(spark, d):
    df = members(spark, d).withColumn("predicted", ME.hard_prediction())
    return df.groupBy("model", "predicted").agg(
        F.count("*").alias("n"), F.sum(EVENT).alias("events")
    )


# --- error analysis ---------------------------------------------------------------------


def error_rows(spark, d):
    df = FE.compute_temporal_features(predicted(spark, d))
    return ER.per_sample_errors(df)


@query
def per_sample_brier(spark, d):
    return rounded(error_rows(spark, d).select(ID, "brier_sample", "label_72h", "abs_err_72h"))


@query
def error_summary(spark, d):
    return rounded(ER.error_summary(error_rows(spark, d)))


@query
def worst_k(spark, d):
    return rounded(ER.worst_k(error_rows(spark, d)))


@query
def worst_decile_profile(spark, d):
    return rounded(ER.worst_decile_profile(error_rows(spark, d), CONTINUOUS), 5)


@query
def error_by_band(spark, d):
    return rounded(ER.error_by_band(error_rows(spark, d)))


@query
def error_by_time(spark, d):
    return rounded(ER.error_by_time(error_rows(spark, d)))


@query
def false_negatives(spark, d):
    # closed-form probabilities stay above 0.3 at 72 h, so the stand-in is halved
    low = predicted(spark, d).withColumn("prob_72h", F.col("prob_72h") * 0.5)
    return rounded(ER.false_negatives(ER.per_sample_errors(low)).select(ID, TIME, "prob_72h"))


@query
def false_positives(spark, d):
    return rounded(ER.false_positives(error_rows(spark, d)).select(ID, TIME, "prob_72h"))


@query
def describe_predictions(spark, d):
    df = predicted(spark, d).withColumn("all_rows", F.lit("all"))
    return rounded(ST.describe_by(df, "all_rows", PROB_COLS))


# --- ensembles, resampling, output ------------------------------------------------------


@query
def monotone_repair(spark, d):
    c = members(spark, d).filter("model = 'c'").select(ID, *PROB_COLS)
    return rounded(enforce_monotonicity(c))


@query
def weighted_average_members(spark, d):
    return rounded(weighted_average(members(spark, d), {"a": 3.0, "b": 1.0, "c": 1.0}))


@query
def stratified_folds(spark, d):
    return RE.stratified_folds(subject_table(spark, d).select(ID, EVENT), 5, 42)


@query
def repeated_fold_counts(spark, d):
    folds = RE.repeated_folds(subject_table(spark, d).select(ID, EVENT), 5, 3, 42)
    return folds.groupBy("repeat", "fold").agg(
        F.count("*").alias("n"), F.sum(EVENT).alias("events"), F.sum(ID).alias("id_sum")
    )


@query
def holdout_split(spark, d):
    return RE.stratified_holdout(subject_table(spark, d).select(ID, EVENT), 0.25, 42)


@query
def km_baseline_predict(spark, d):
    from durata.models.marginal import KaplanMeierModel

    df = subject_table(spark, d)
    model = KaplanMeierModel().fit(EV.train_split(df))
    return rounded(model.predict(EV.test_split(df)).select(ID, *PROB_COLS))


@query
def submission(spark, d):
    from durata.plans.jobs import format_submission

    preds = members(spark, d).filter("model = 'c'").withColumn("prob_72h", F.col("prob_72h") * 1.2)
    return rounded(format_submission(preds))


@query
def cv_metric_summary(spark, d):
    df = RE.stratified_folds(predicted(spark, d), 5, 42)
    wide = ME.core_scores(df, ["fold"])
    names = ["weighted_brier", "brier_mean", "brier_72h_ca"]
    tall = wide.select("fold", *names).unpivot(["fold"], names, "metric", "value")
    return rounded(ME.fold_summary(tall.withColumn("model", F.lit("closed_form")), ["model"]))


@query
def binned_mutual_information(spark, d):
    return rounded(SE.mutual_information(subject_table(spark, d), EV.FEATURES))


@query
def select_features(spark, d):
    df = subject_table(spark, d)
    kept = SE.select_features(df, EV.FEATURES, mi_threshold=0.0005)
    return df.sparkSession.createDataFrame([(c,) for c in kept], "feature string")


@query
def stars(spark, d):
    out = subject_table(spark, d).select(significance_stars(F.col("k") / 1000.0).alias("stars"))
    return out.groupBy("stars").agg(F.count("*").alias("n"))


@query
def median_imputation(spark, d):
    from durata.functions.impute import MedianImputer

    df = with_holes(subject_table(spark, d))
    filled = MedianImputer(["dist_min_ci_0_5h", "alignment_abs"]).fit(EV.train_split(df)).transform(df)
    return rounded(filled.select(ID, "dist_min_ci_0_5h", "alignment_abs"))


@query
def joint_median_imputation(spark, d):
    from durata.functions.impute import impute_jointly

    df = with_holes(subject_table(spark, d)).select(ID, "user_id", "dist_min_ci_0_5h")
    a, b = impute_jointly(EV.train_split(df), EV.test_split(df), ["dist_min_ci_0_5h"])
    both = a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))
    return rounded(both.select(ID, "split", "dist_min_ci_0_5h"))


@query
def factorized_types(spark, d):
    from durata.functions.columns import factorize

    coded = factorize(subject_table(spark, d).select(ID, "event_type"), ["event_type"])
    return coded.groupBy(F.col("event_type").alias("code")).agg(
        F.count("*").alias("n"), F.sum(ID).alias("id_sum")
    )


@query
def best_model(spark, d):
    from durata.sources.tables import best_model as pick

    scores = ME.weighted_brier(members(spark, d), ["model"]).select(
        "model", (-F.col("weighted_brier")).alias("hybrid_score")
    )
    return spark.createDataFrame([(pick(scores),)], "model string")


