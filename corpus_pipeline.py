"""Corpus pipeline: from raw documents to a mixed training corpus, stage by stage.

Each stage takes the documents that its predecessor kept and calls one operator of
``durata.llm``. All but the last return the columns of ``documents``:

1. quality: documents whose quality posterior is below one half go.
2. line_dedup: repeated and near-equal lines are cut, emptied documents go.
3. near_dedup: one document of each group of near-duplicates stays.
4. decontamination: documents that overlap with a benchmark item go.
5. mixing: what each source contributes to the target mix; documents with no share go.

``run`` writes every stage as Parquet into the shared folder of ``spark.checkpoint.dir`` and
reads it again for the next. No stage past the first can be put in SQL (hashes, classifiers),
so ``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from durata.llm import decontamination, lines, mixing, quality, simhash
from durata.llm.common import table

ORACLE_SQL: str | None = None
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts in an Arrow batch: Spark's 10,000 lie in memory several times, in each task's JVM and Python.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows an Arrow batch, from here on in this session (``run`` puts it back)."""
    rows = int(spark.conf.get(BATCH_CONF))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    scored = quality.with_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(f"quality >= {quality.THRESHOLD}").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.line_dedup(docs).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return simhash.drop_similar(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("taken > 0")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-pipeline-")
    return f"{folder}/corpus-pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH_CONF)
    try:
        for number, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{number}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, before)
    return docs
