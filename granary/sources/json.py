"""JSON Lines."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.frame import Frame


def read(spark: SparkSession, path: str, schema: str | None = None) -> Frame:
    """One object a line; booleans become integers, arrays of numbers vectors, objects dicts; other lines are an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return Frame.of((reader.schema(schema) if schema else reader).json(path))


def write(frame: Frame, path: str) -> None:
    """Missing values are written as null, NaN and infinities too."""
    df = frame.df
    finite = [F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*finite).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
