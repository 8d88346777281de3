"""Streams into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to the data of a table folder; the checkpoint makes it exactly once."""
    return stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
