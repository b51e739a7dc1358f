"""Per-partition numpy partial sums, merged by a keyed aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_matrix(batch: pa.RecordBatch, columns: list[str] | None = None) -> np.ndarray:
    """Columns of an Arrow batch as a float matrix, null becomes NaN."""
    names = columns or batch.schema.names
    out = np.empty((batch.num_rows, len(names)))
    for j, name in enumerate(names):
        out[:, j] = batch.column(name).to_numpy(zero_copy_only=False)
    return out


def partition_cells(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """(pos, v): sum of ``fn(rows)`` (a vector of ``size``) over all rows of a numeric frame.

    Each task emits one dense vector of fixed size; vectors are added position by position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fn(batch_matrix(batch))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["pos", "v"]
        )

    return df.mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))


def partition_sums(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``partition_cells`` as a vector: the driver receives ``size`` numbers whatever the row count."""
    out = np.zeros(size)
    for r in partition_cells(df, fn, size).collect():
        out[r["pos"]] = r["v"]
    return out
