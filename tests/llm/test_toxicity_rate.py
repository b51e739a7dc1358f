"""The toxicity scores follow the labels' own rate."""

import random

import numpy as np

from durata.llm import toxicity


def test_toxicity_does_not_drift_with_the_larger_class(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(3000):
        bad = int(i % 10 == 0)
        words = [rng.choice(["sky", "tree", "road", "lake", "stone"]) for _ in range(6)]
        words += ["awful"] if rng.random() < (0.6 if bad else 0.05) else []
        rows.append((i, " ".join(words)))
        labels.append((i, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    texts = ["sky tree road", "sky tree awful"]
    logit = lambda p: np.log(p / (1 - p))
    whole = logit(toxicity.fit(docs, labels, sample=10_000).scores(texts))
    cut = logit(toxicity.fit(docs, labels, sample=300).scores(texts))
    assert np.abs(whole - cut).max() < 0.6
    scores = toxicity.fit(docs, labels, sample=300).scores([t for _, t in rows])
    assert abs(scores.mean() - 0.1) < 0.03
