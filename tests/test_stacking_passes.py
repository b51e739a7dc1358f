"""A meta-learner's steps run over a partition a core, whatever the shuffle partitions."""

from durata.constants import EVENT, ID, PROB_COLS, TIME
from durata.models import stacking
from durata.models.stacking import MetaLearner


def test_steps_run_over_a_partition_a_core(spark, monkeypatch):
    cols = ", ".join(f"(id * {7 + i} + hash(m)) % 50 / 100D as {c}" for i, c in enumerate(PROB_COLS))
    preds = spark.range(400).selectExpr("id", "explode(array('a', 'b')) as m").selectExpr(
        f"id as {ID}", "m as model", f"id % 90 + 1D as {TIME}", f"cast(id % 3 = 0 as long) as {EVENT}", *cols.split(", ")
    )
    seen, plain = [], stacking.LogisticRegression.fit
    monkeypatch.setattr(
        stacking.LogisticRegression, "fit",
        lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df),
    )
    names = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        MetaLearner().fit(preds.repartition(10), ["a", "b"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(seen) == 4 and max(seen) <= spark.sparkContext.defaultParallelism
