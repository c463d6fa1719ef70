"""Structured Streaming: apply a model to every arriving row once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(
    stream: DataFrame, model, path: str, checkpoint: str, available_now: bool = True, interval: str = "10 seconds"
) -> StreamingQuery:
    """Start a query that writes scored rows to parquet files, each exactly once.

    ``model`` is anything with ``transform``. Scoring keeps no state, so the
    query needs no watermark; offsets and the file log live in ``checkpoint``.
    """
    writer = (
        model.transform(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
