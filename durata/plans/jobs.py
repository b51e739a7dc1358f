"""End-to-end jobs composed from the operators."""

from __future__ import annotations

import datetime
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from durata.constants import EVENT, ID, PROB_COLS, SUBMISSION_COLUMNS, TIME, VALID_RANGES
from durata.functions.columns import cast_to_schema, enforce_monotonicity
from durata.functions.features import engineer_features
from durata.models.base import default_features
from durata.models.importance import compare_top_n, permutation_importance, recursive_elimination
from durata.models.stacking import IsotonicCalibrator, MetaLearner
from durata.models.validation import (
    cross_validate,
    holdout_predictions,
    oof_predictions,
    refit_and_predict,
)
from durata.operators.ensemble import average_of, best_weights, hybrid_of_columns, members_wide, weighted_average
from durata.operators.metrics import all_metrics
from durata.operators.quality import validate_dataset, validate_submission
from durata.session import cut_lineage
from durata.sources.tables import (
    best_model,
    metrics_to_long,
    read_csv,
    read_parquet,
    write_csv,
    write_parquet,
    write_results,
)


def process_dataset(
    spark: SparkSession, raw_path: str, out_path: str, schema: StructType, expected_rows: int
) -> DataFrame:
    """CSV to typed, validated Parquet. The expected count must come from outside."""
    df = cast_to_schema(read_csv(spark, raw_path, schema), schema)
    validate_dataset(df, schema, [f.name for f in schema.fields], VALID_RANGES, expected_rows)
    write_parquet(df, out_path)
    return spark.read.parquet(out_path)


def build_features(
    spark: SparkSession, in_path: str, out_path: str, dist_edges: list[float] | None = None
) -> DataFrame:
    """Processed Parquet to the feature table of one split."""
    write_parquet(engineer_features(read_parquet(spark, in_path), dist_edges), out_path)
    return spark.read.parquet(out_path)


def score_batch(model, df: DataFrame, out_path: str | None = None) -> DataFrame:
    """Id and probabilities of a fitted model, written when a path is given."""
    scored = model.predict(df).select(ID, *PROB_COLS)
    if out_path:
        write_parquet(scored, out_path)
    return scored


def format_submission(predictions: DataFrame, expected_ids: DataFrame | None = None) -> DataFrame:
    """Contract columns in order, monotone and within [0, 1]; checked when ids are given."""
    out = enforce_monotonicity(
        predictions.select(F.col(ID).cast("long").alias(ID), *PROB_COLS)
    ).select(*SUBMISSION_COLUMNS)
    if expected_ids is not None:
        validate_submission(out, expected_ids)
    return out


def write_submission(
    predictions: DataFrame, expected_ids: DataFrame, folder: str, model: str = "random_forest"
) -> str:
    path = f"{folder}/submission_{model}_{datetime.date.today().isoformat()}"
    return write_csv(format_submission(predictions, expected_ids), path)


def train_and_compare(
    factories: dict,
    train: DataFrame,
    features: list[str] | None = None,
    k: int = 5,
    seed: int = 42,
    results_path: str | None = None,
) -> DataFrame:
    """Cross-validate and fully fit every model; one failing model does not stop the others.

    Long table (model, metric, value, error, seconds): ``<metric>_mean_cv``, ``_std_cv``
    and the full-fit scores.
    """
    spark = train.sparkSession
    parts = []
    for name, factory in factories.items():
        began = time.monotonic()
        try:
            cv = cross_validate(factory, train, features, k, seed, name)
            tall = cv.selectExpr(
                "model", "inline(array("
                "named_struct('metric', concat(metric, '_mean_cv'), 'value', mean),"
                "named_struct('metric', concat(metric, '_std_cv'), 'value', std)))",
            )
            fitted = factory().fit(train, features)
            scored = cut_lineage(fitted.predict(train).select(TIME, EVENT, *PROB_COLS))
            full = all_metrics(scored).drop("n").withColumn("model", F.lit(name))
            rows = [
                (r["model"], r["metric"], r["value"])
                for r in tall.unionByName(metrics_to_long(full, ["model"])).collect()
            ]
            error = None
        except Exception as e:  # noqa: BLE001 - the error is part of the comparison
            rows, error = [(name, "hybrid_score_mean_cv", None)], str(e)
        seconds = time.monotonic() - began
        parts += [(*r, error, seconds) for r in rows]
    out = spark.createDataFrame(
        parts, "model string, metric string, value double, error string, seconds double"
    )
    if results_path:
        write_results(out, results_path, "overwrite")
    return out


def pick_best(results: DataFrame, metric: str = "hybrid_score_mean_cv") -> str | None:
    scores = results.filter(F.col("metric") == metric).withColumnRenamed("value", "score")
    return best_model(scores, "score")


def selection_report(
    df: DataFrame,
    factory,
    features: list[str] | None = None,
    folder: str | None = None,
    keep: int = 30,
    n_list: tuple[int, ...] = (20, 30, 50),
    **forest: int,
) -> dict[str, DataFrame | list[str]]:
    """Permutation ranking, elimination list and top-N comparison, written when asked."""
    ranking = permutation_importance(df, features, **forest)
    order = [r["feature"] for r in ranking.collect()]
    kept = recursive_elimination(df, features, keep)
    subsets = compare_top_n(df, order, factory, n_list)
    if folder:
        write_csv(ranking, f"{folder}/permutation_importance")
        rows = df.sparkSession.createDataFrame([(c,) for c in kept], "feature string")
        write_csv(rows, f"{folder}/rfe_features")
        write_csv(subsets, f"{folder}/subset_cv_summary")
    return {"ranking": ranking, "kept": kept, "subsets": subsets}


def evaluate_model(name: str, predictions: DataFrame, results_path: str | None = None) -> DataFrame:
    """All metrics of one prediction set in long form, appended to the results table."""
    wide = all_metrics(predictions).drop("n").withColumn("model", F.lit(name))
    tall = metrics_to_long(wide, ["model"])
    if results_path:
        write_results(tall, results_path)
    return tall


def run_ensemble(
    factories: dict,
    train: DataFrame,
    test: DataFrame,
    features: list[str] | None = None,
    k: int = 5,
    seed: int = 42,
    calibrate: bool = True,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Members, three ensembles, best pick by out-of-fold hybrid score, guarded calibration.

    Returns (test predictions of the winner, comparison table). Out-of-fold predictions lie side by
    side in one row an id, where members and ensembles are combined and compared without a shuffle more.
    """
    features = default_features(train, features)
    names = list(factories)
    truth = [ID, TIME, EVENT]

    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("model", F.lit(name))

    def collected(parts: list[DataFrame]) -> DataFrame:
        """Predictions of all members as one stored table, so no later job refits or rescores."""
        return cut_lineage(reduce(DataFrame.unionByName, parts))

    cols = [*truth, "model", *PROB_COLS]
    oof = collected(
        [tagged(oof_predictions(f, train, features, k, seed), n).select(*cols) for n, f in factories.items()]
    )
    test_preds = collected(
        [tagged(refit_and_predict(f, train, test, features)[1], n) for n, f in factories.items()]
    )
    holdout = collected(
        [
            tagged(holdout_predictions(f, train, features, 0.25, seed), n).select(*cols)
            for n, f in factories.items()
        ]
    )
    # one row an id: weights, meta-learners and the three ensembles work on it row by row
    wide = cut_lineage(members_wide(oof, names, [TIME, EVENT]).drop("__members"))
    weights = best_weights(wide, names)
    stack = MetaLearner().fit_wide(wide, names)
    blend = MetaLearner().fit(holdout, names)
    combine = {
        "weighted_average": lambda p: weighted_average(p, weights),
        "stacking": stack.predict,
        "blending": blend.predict,
    }
    scored, sets = wide, {n: [f"{c}__{i}" for c in PROB_COLS] for i, n in enumerate(names)}
    for n, fn in {
        "weighted_average": lambda w: average_of(w, names, weights), "stacking": stack.combine, "blending": blend.combine,
    }.items():
        sets[n] = [f"{c}__{n}" for c in PROB_COLS]
        scored = fn(scored).withColumnsRenamed(dict(zip(PROB_COLS, sets[n], strict=True)))
    scored = cut_lineage(scored)
    comparison = hybrid_of_columns(scored, sets)
    best, best_hybrid = max(((r[0], r[1]) for r in comparison if r[1] is not None), key=lambda t: (t[1], t[0]))
    final = combine[best](test_preds) if best in combine else (
        test_preds.filter(F.col("model") == best).select(ID, *PROB_COLS)
    )
    if calibrate:
        best_oof = scored.selectExpr(*truth, *[f"`{x}` as `{c}`" for c, x in zip(PROB_COLS, sets[best], strict=True)])
        calibrator = IsotonicCalibrator().fit(best_oof)
        after = cut_lineage(calibrator.transform(best_oof))
        comparison += hybrid_of_columns(after, {f"{best}_calibrated": PROB_COLS})
        if comparison[-1][1] >= best_hybrid:
            final = calibrator.transform(final)
    final = enforce_monotonicity(final)
    table = train.sparkSession.createDataFrame(
        [(*r, weights.get(r[0]), r[0] == best) for r in comparison],
        "model string, hybrid_score double, weighted_brier double, c_index double, "
        "weight double, selected boolean",
    )
    if folder:
        write_parquet(oof, f"{folder}/oof_predictions", ["model"])
        write_parquet(test_preds, f"{folder}/test_predictions", ["model"])
        write_parquet(final, f"{folder}/predictions_ensemble")
        write_results(table, f"{folder}/ensemble_results", "overwrite")
    return final, table
