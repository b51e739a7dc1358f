"""Scoring a stream with a fitted model: features and probabilities are row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from durata.constants import ID, PROB_COLS
from durata.models.base import HorizonModel


def score_stream(
    model: HorizonModel, stream: DataFrame, out_path: str, checkpoint_path: str
) -> StreamingQuery:
    """Write id and probabilities of every available row, then stop."""
    scored = model.predict(stream).select(ID, *PROB_COLS)
    return (
        scored.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
