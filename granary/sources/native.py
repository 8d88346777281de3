"""The engine's own table folder: Parquet files and a JSON sidecar with the metadata."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.frame import Frame


def save(frame: Frame, path: str) -> None:
    frame.df.write.mode("overwrite").parquet(f"{path}/data")
    spark = frame.df.sparkSession
    spark.createDataFrame([(json.dumps(frame.metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Frame:
    row = spark.read.text(f"{path}/metadata").first()
    return Frame(spark.read.parquet(f"{path}/data"), json.loads(row["value"]) if row else {})
