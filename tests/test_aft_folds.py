"""Folds of an AFT model share every pass over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from durata.constants import EVENT, ID, TIME
from durata.models import aft
from durata.models.aft import AFTModel


@pytest.mark.parametrize(("distribution", "l1_ratio"), [("weibull", 0.0), ("lognormal", 0.5)])
def test_folds_together_are_the_fits_one_by_one(spark, monkeypatch, distribution, l1_ratio):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        x, y = float(rng.normal(3, 2)), float(rng.integers(0, 4))
        t = float(rng.exponential(np.exp(2 + 0.3 * x - 0.2 * y)))
        rows.append((i, min(t, 40.0), int(t <= 40), None if i % 7 == 0 else x, float("nan") if i % 11 == 0 else y, 5.0, i % 3))
    df = spark.createDataFrame(rows, f"{ID} long, {TIME} double, {EVENT} long, x double, y double, z double, fold int")
    names, passes, plain = ["x", "y", "z"], [], aft.partition_sums
    monkeypatch.setattr(aft, "partition_sums", lambda *a: passes.append(1) or plain(*a))
    base = AFTModel(distribution, 0.02, l1_ratio=l1_ratio)
    together = base.fit_folds(df, names, [0, 1, 2])
    assert len(passes) == max(m.evaluations for m in together.values())
    for f, m in together.items():
        one = AFTModel(distribution, 0.02, l1_ratio=l1_ratio).fit(df.where(F.col("fold") != f), names)
        assert m.medians == one.medians
        np.testing.assert_allclose(m.mean, one.mean, rtol=1e-12)
        np.testing.assert_allclose(m.scale, one.scale, rtol=1e-10)
        np.testing.assert_allclose(m.params, one.params, rtol=1e-6, atol=1e-7)
