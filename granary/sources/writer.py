"""Building a table batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..types import SPARK, dtype


class StreamWriter:
    """Columns are matched by name; finish() makes the folder a table of sources.native. A context manager."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str], buffer_rows: int = 100_000):
        self.spark, self.path, self.columns, self.most = spark, path, {c: dtype(t) for c, t in columns.items()}, buffer_rows
        self.rows: list[tuple] = []
        self.metadata: dict[str, str] = {}
        self.mode = "overwrite"

    def write_batch(self, batch: dict[str, list]) -> None:
        if set(batch) != set(self.columns) or len({len(v) for v in batch.values()}) > 1:
            raise ValueError("a batch needs all columns in one length")
        self.rows += zip(*[batch[c] for c in self.columns])
        if len(self.rows) >= self.most:
            self._flush()

    def set_metadata(self, key: str, value: str) -> None:
        self.metadata[key] = value

    def _flush(self) -> None:
        schema = ", ".join(f"`{c}` {SPARK[t].simpleString()}" for c, t in self.columns.items())
        self.spark.createDataFrame(self.rows, schema).write.mode(self.mode).parquet(f"{self.path}/data")
        self.rows, self.mode = [], "append"

    def finish(self) -> None:
        if self.rows or self.mode == "overwrite":
            self._flush()
        self.spark.createDataFrame([(json.dumps(self.metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/metadata")

    def __enter__(self) -> StreamWriter:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.finish()
