"""Registered queries run whole searches."""

import inspect

from durata.models import validation
from durata.operators.ensemble import optimize_weights
from durata.plans import models_catalog


def test_query_searches_all_rounds(spark, monkeypatch):
    """The registered query leaves out none of the search's rounds."""
    asked = {}

    def seen(*args, **kw):
        asked.update(inspect.signature(optimize_weights).bind(*args, **kw).arguments)
        return {"a": 1.0}

    monkeypatch.setattr(models_catalog, "best_weights", seen)
    models_catalog.optimize_weights(spark, "/root/testdata/sf0.001")
    assert asked.keys() <= {"predictions", "models"}


def test_query_nests_whole_searches(spark, monkeypatch):
    """Folds, trials and search space of the registered query are those of the search itself."""
    asked = {}

    def seen(*args, **kw):
        asked.update(inspect.signature(validation.nested_cv).bind(*args, **kw).arguments)

    monkeypatch.setattr(models_catalog, "nested", seen)
    models_catalog.nested_cv(spark, "/root/testdata/sf0.001")
    assert asked.keys() <= {"build", "df", "space", "features"}
    assert asked["space"] == "random_survival_forest" and asked["build"] is models_catalog.SurvivalForest


def test_trials_share_their_folds(spark, monkeypatch):
    rows = [(i, float(i % 7), 1.0 + i % 50, i % 3 % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, a double, time_to_hit_hours double, event int")
    tagged = []
    plain = validation._tagged
    monkeypatch.setattr(validation, "_tagged", lambda *a: tagged.append(1) or plain(*a))
    space = {"n_estimators": ("int", 2, 4)}
    trials = validation.tune(models_catalog.SurvivalForest, df, space, ["a"], n_trials=3, k=2).collect()
    assert len(tagged) == 1 and all(t.error is None for t in trials) and len(trials) == 3
