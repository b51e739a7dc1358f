"""Ensembles are combined and compared side by side, from one row an id."""

import random

import pytest

from durata.constants import EVENT, ID, PROB_COLS, TIME
from durata.models.stacking import MetaLearner
from durata.operators import ensemble as EN
from durata.operators.metrics import hybrid_score
from durata.plans import jobs


def long(spark, n=160):
    rng, rows = random.Random(6), []
    for i in range(n):
        t, e = float(rng.randint(1, 90)), rng.randint(0, 1)
        for m in ("one", "two"):
            rows.append((i, m, min(t, 72.0), int(e and t <= 72), *sorted(round(rng.random(), 2) for _ in PROB_COLS)))
    cols = ", ".join(f"{c} double" for c in PROB_COLS)
    return spark.createDataFrame(rows, f"{ID} long, model string, {TIME} double, {EVENT} int, {cols}")


def by_id(df):
    return [list(r) for r in df.select(ID, *PROB_COLS).orderBy(ID).collect()]


def test_side_by_side_equals_long(spark):
    preds, names = long(spark), ["one", "two"]
    wide = EN.members_wide(preds, names, [TIME, EVENT]).persist()
    sets = {m: [f"{c}__{i}" for c in PROB_COLS] for i, m in enumerate(names)}
    got = {r[0]: r[1:] for r in EN.hybrid_of_columns(wide, sets)}
    want = hybrid_score(preds, ["model"]).select("model", "hybrid_score", "weighted_brier", "c_index").collect()
    assert {r[0]: pytest.approx(tuple(r[1:]), abs=1e-12) for r in want} == got
    weights = {"two": 1.0, "one": 3.0}
    for a, b in zip(by_id(EN.average_of(wide, names, weights)), by_id(EN.weighted_average(preds, weights)), strict=True):
        assert a == pytest.approx(b, abs=1e-12)
    meta = MetaLearner().fit(preds, names)
    assert by_id(meta.combine(wide)) == by_id(meta.predict(preds))


def test_members_are_put_side_by_side_once(spark, monkeypatch):
    """Weights, both meta-learners and three ensembles take one table of the out-of-fold rows."""
    from durata.models.marginal import KaplanMeierModel

    rows = long(spark).where("model = 'one'").drop("model").withColumnRenamed("prob_12h", "x").select(ID, TIME, EVENT, "x")
    made = []
    plain = EN.members_wide

    def seen(*a, **k):
        made.append(1)
        return plain(*a, **k)

    for module in (EN, jobs, __import__("durata.models.stacking", fromlist=["x"])):
        monkeypatch.setattr(module, "members_wide", seen)
    models = {"a": KaplanMeierModel, "b": KaplanMeierModel}
    final, table = jobs.run_ensemble(models, rows.where(f"{ID} % 4 > 0"), rows.where(f"{ID} % 4 = 0"), ["x"], k=2, calibrate=False)
    # one for the out-of-fold rows, one for the holdout; the winner's final predictions are one more at most
    assert len(made) <= 3 and table.count() == 5 and final.count() == 40
