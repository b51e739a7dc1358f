"""Subtrees are grown level by level in array work, and dealt out a few trees at a time."""

import math
import random

import numpy as np
import pytest

from durata.models import forest
from durata.models.forest import Leaves, SurvivalForest


def node_data(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(1, 20, n), rng.integers(1, 7, n), rng.integers(0, 3, n), rng.integers(1, 12, n)], 1).astype(np.uint8)
    t = np.round(rng.exponential(np.exp(2 + x[:, 0] / 10.0)), 1)
    times = [np.unique([*np.quantile(t, np.arange(1, 13) / 13), 12.0, 24.0, 48.0, 72.0])]
    rules = Leaves(4, 21, times, 6, 3, None)
    return rules, x, rng.poisson(1, n) + 1.0, np.searchsorted(times[0], t, "left"), (rng.random(n) < 0.6).astype(float)


def test_a_level_is_scored_together(monkeypatch):
    """Far fewer calls of the statistic than nodes, and the same tree from rows and from histograms."""
    rules, *data = node_data()
    calls = []
    plain = forest.logrank
    monkeypatch.setattr(forest, "logrank", lambda *a: calls.append(1) or plain(*a))
    tree = rules.subtree(*data, 0, 11, 1, 0)
    assert len(tree["feature"]) > 500 and len(calls) < len(tree["feature"]) / 3
    for cells, sizes in ((2_000, forest.SIZES), (50_000, ()), (50_000, (16, 64))):
        monkeypatch.setattr(forest, "CELLS", cells)
        monkeypatch.setattr(forest, "SIZES", sizes)
        again = rules.subtree(*data, 0, 11, 1, 0)
        for name in ("feature", "left", "right", "depth"):
            assert np.array_equal(again[name], tree[name]), (sizes, name)
        assert np.allclose(again["value"], tree["value"])


def test_trees_do_not_depend_on_turns(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), 1.0 + rng.expovariate(0.03), int(rng.random() < 0.7)) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, time_to_hit_hours double, event long")
    build = lambda: SurvivalForest(n_estimators=5, seed=2).fit(df, ["a", "b"])
    whole = build()
    turns = []
    plain = forest._turns
    monkeypatch.setattr(forest, "_turns", lambda *a: (turns.append(p) or p for p in plain(*a)))
    monkeypatch.setattr(forest, "DEALT_ROWS", 600)
    parts = build()
    assert len(turns) == 5
    for a, b in zip(whole.trees, parts.trees, strict=True):
        assert isinstance(a.feature, np.ndarray) and a.to_dict() == b.to_dict()
    assert SurvivalForest.from_json(whole.to_json()).trees[0].to_dict() == whole.trees[0].to_dict()


def test_features_of_a_node_are_drawn_alike_alone_and_together():
    rules = Leaves(9, 8, [np.array([12.0])], 2, 1, None)
    keys = np.array([1, 77, 2**63 + 5], dtype=np.uint64)
    many = rules.picked_of(5, keys)
    assert [rules.picked(5, int(k)).tolist() for k in keys] == many.tolist()
    counts = np.bincount(rules.picked_of(5, np.arange(1, 9001, dtype=np.uint64)).ravel(), minlength=9)
    assert many.shape == (3, 3) and counts == pytest.approx(np.full(9, 3000), abs=6 * math.sqrt(3000))
