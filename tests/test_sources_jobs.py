import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from durata.constants import PROB_COLS, TRAIN_SCHEMA, VALID_RANGES
from durata.models.aft import weibull_model
from durata.models.marginal import KaplanMeierModel
from durata.operators.scan import positions
from durata.plans.jobs import (
    build_features,
    evaluate_model,
    format_submission,
    pick_best,
    process_dataset,
    run_ensemble,
    score_batch,
    selection_report,
    train_and_compare,
    write_submission,
)
from durata.sources import events as EV
from durata.sources.tables import (
    best_model,
    column_groups,
    default_model,
    group_columns,
    read_csv,
    read_parquet,
    write_csv,
    write_parquet,
)

FEATURES = ["dist_min_ci_0_5h", "closing_speed_m_per_h", "area_growth_rate_ha_per_h"]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="module")
def planted(spark, sf):
    return EV.planted_subjects(spark, sf).persist()


def raw_subjects(spark, n=60):
    cols = []
    for i, f in enumerate(TRAIN_SCHEMA.fields):
        lo, hi = VALID_RANGES.get(f.name, (0, 100))
        span = int(hi - lo) + 1 if f.dataType.simpleString() == "bigint" else hi - lo
        c = F.col("id") if f.name == "event_id" else F.pmod(F.col("id") * (i + 3), F.lit(span)) + lo
        cols.append(c.cast(f.dataType).alias(f.name))
    return spark.range(n).select(cols)


def test_raw_to_features(spark, folder):
    raw = raw_subjects(spark)
    # columns in another order, one extra: bound by name
    write_csv(raw.select("event", *[c for c in raw.columns if c != "event"]), f"{folder}/raw")
    out = process_dataset(spark, f"{folder}/raw", f"{folder}/processed", TRAIN_SCHEMA, 60)
    assert out.count() == 60 and dict(out.dtypes) == dict(raw.dtypes)
    again = process_dataset(spark, f"{folder}/raw", f"{folder}/processed", TRAIN_SCHEMA, 60)
    assert again.count() == 60
    feats = build_features(spark, f"{folder}/processed", f"{folder}/features")
    assert len(feats.columns) == 50
    with pytest.raises(ValueError, match="row_count"):
        process_dataset(spark, f"{folder}/raw", f"{folder}/processed2", TRAIN_SCHEMA, 100)
    write_csv(raw.withColumn("event", F.lit(7)), f"{folder}/bad")
    with pytest.raises(ValueError, match="ranges"):
        process_dataset(spark, f"{folder}/bad", f"{folder}/processed3", TRAIN_SCHEMA, 60)


def test_scans_and_sinks(spark, folder):
    df = spark.createDataFrame([(1, "x", 0.5), (2, None, 1.5)], "a long, s string, v double")
    write_parquet(df, f"{folder}/deep/er/p")
    assert read_parquet(spark, f"{folder}/deep/er/p", ["v"]).columns == ["v"]
    write_csv(df, f"{folder}/c", single_file=True)
    assert len([f for f in os.listdir(f"{folder}/c") if f.endswith(".csv")]) == 1
    assert {tuple(r) for r in read_csv(spark, f"{folder}/c", df.schema).collect()} == {(1, "x", 0.5), (2, None, 1.5)}
    assert read_csv(spark, f"{folder}/c").count() == 2


def test_column_groups(spark, sf):
    groups = {r["category"]: r["columns"] for r in group_columns(EV.features_only(spark, sf), column_groups(spark)).collect()}
    assert groups["directionality"] == ["alignment_abs", "alignment_cos"]


def test_best_model_rules(spark):
    cols = "model string, hybrid_score double, error string"
    rows = [("a", 0.7, None), ("b", None, None), ("c", 0.9, "failed")]
    assert best_model(spark.createDataFrame(rows, cols)) == "a"
    assert default_model(None) == "random_forest"
    assert default_model(spark.createDataFrame(rows[2:], cols)) == "random_forest"


def test_positions_with_a_dominant_value(spark):
    df = spark.range(900).selectExpr("id", "if(id % 3 = 0, 72D, double(pmod(hash(id), 50))) as t")
    got = {r["id"]: r["position"] for r in positions(df.repartition(6), "t", "id").collect()}
    order = sorted((r["t"], r["id"]) for r in df.collect())
    assert got == {i: n + 1 for n, (_, i) in enumerate(order)}


def test_scoring_and_submission(spark, planted, folder):
    train, test = EV.train_split(planted), EV.test_split(planted)
    model = weibull_model().fit(train, FEATURES)
    scored = score_batch(model, test, f"{folder}/scored")
    assert scored.count() == test.count()
    path = write_submission(spark.read.parquet(f"{folder}/scored"), test.select("event_id"), folder, "weibull")
    assert read_csv(spark, path).columns == ["event_id", *PROB_COLS]
    with pytest.raises(ValueError, match="rows"):
        format_submission(scored, planted.select("event_id"))
    evaluate_model("weibull", model.predict(train), f"{folder}/results")
    evaluate_model("km", KaplanMeierModel().fit(train).predict(train), f"{folder}/results")
    results = spark.read.json(f"{folder}/results")
    assert {r[0] for r in results.select("model").distinct().collect()} == {"weibull", "km"}


class Broken(KaplanMeierModel):
    def fit(self, df, features=None):
        raise RuntimeError("no convergence")

    fit_folds = KaplanMeierModel.fit_folds


def test_comparison_isolates_failures(planted):
    out = train_and_compare({"broken": Broken, "km": KaplanMeierModel, "weibull": weibull_model}, planted, FEATURES, k=3)
    errors = {r["model"]: r["error"] for r in out.select("model", "error").distinct().collect()}
    assert "no convergence" in errors["broken"] and errors["km"] is None
    assert pick_best(out) == "weibull"


def test_ensemble_job(spark, planted, folder):
    train, test = EV.train_split(planted), EV.test_split(planted)
    members = {"km": KaplanMeierModel, "weibull": weibull_model}
    final, table = run_ensemble(members, train, test, FEATURES, k=3, folder=folder)
    rows = {r["model"]: r for r in table.collect()}
    assert {"km", "weibull", "weighted_average", "stacking", "blending"} <= set(rows)
    chosen = [m for m, r in rows.items() if r["selected"]]
    plain = [r["hybrid_score"] for m, r in rows.items() if not m.endswith("_calibrated")]
    assert len(chosen) == 1 and rows[chosen[0]]["hybrid_score"] == max(plain)
    assert rows["km"]["weight"] + rows["weibull"]["weight"] == pytest.approx(1)
    assert final.count() == test.count()
    assert spark.read.parquet(f"{folder}/oof_predictions").count() == 2 * train.count()
    assert json.loads(spark.read.text(f"{folder}/ensemble_results").first()[0])["model"]


def test_selection_report(spark, planted, folder):
    out = selection_report(
        planted, KaplanMeierModel, [*FEATURES, "alignment_abs"], folder, keep=2, n_list=(2,), n_repeats=1, trees=5, max_depth=4
    )
    assert len(out["kept"]) == 2 and out["subsets"].count() == 1
    assert read_csv(spark, f"{folder}/permutation_importance").count() == 4
