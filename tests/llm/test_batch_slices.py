"""Texts of an Arrow batch become Python objects a slice at a time."""

import corpus_pipeline
import pyarrow as pa

from durata.llm import common


def test_slices_hold_every_row_once():
    batches = [pa.record_batch({"x": list(range(2500))}), pa.record_batch({"x": pa.array([], pa.int64())})]
    out = list(common.slices(iter(batches)))
    assert [b.num_rows for b in out] == [1000, 1000, 500]
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(2500))


def test_pipeline_takes_modest_batches(spark, monkeypatch):
    """Tasks get at most ``BATCH_ROWS`` texts at once; afterwards the session is as it was."""
    before = spark.conf.get(corpus_pipeline.BATCH_CONF)
    seen = []

    def stage(session, docs, folder):
        corpus_pipeline.modest_batches(session)

        def run(batches):
            for b in batches:
                yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

        seen.append(max(r.n for r in session.range(0, 5000, 1, 1).mapInArrow(run, "n long").collect()))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage)])
    monkeypatch.setattr(corpus_pipeline, "table", lambda session, folder, name: session.range(3))
    assert corpus_pipeline.run(spark, "").count() == 3
    assert seen == [corpus_pipeline.BATCH_ROWS]
    assert spark.conf.get(corpus_pipeline.BATCH_CONF) == before
