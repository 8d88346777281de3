"""Parquet files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import Frame
from ..operators.order import ORD
from ..types import normalise


def read(spark: SparkSession, path: str | list[str], rows: tuple[int, int] | None = None) -> Frame:
    """One path, a glob or several paths; columns and predicates reach the scan. rows: only those from one ordinal up to another, in the order of files and of rows in them."""
    paths = sorted([path] if isinstance(path, str) else path)
    if rows is None:
        return Frame.of(spark.read.parquet(*paths))
    # Rows before each file are known from counts alone; _metadata.row_index prunes row groups within files.
    df = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted(map(tuple, df.groupBy("_file").agg(F.max("_row") + 1).collect()))  # one row a file
    at, inside = 0, F.lit(False)
    start = F.lit(0)
    for name, n in sizes:
        if at < rows[1] and at + n > rows[0]:
            inside |= (F.col("_file") == name) & F.col("_row").between(rows[0] - at, rows[1] - at - 1)
            start = F.when(F.col("_file") == name, at).otherwise(start)
        at += n
    found = df.where(inside).withColumn(ORD, (start + F.col("_row") - rows[0]).cast("long")).drop("_file", "_row")
    return Frame(normalise(found))


def write_sharded(df: DataFrame, prefix: str) -> list[str]:
    """One Parquet file a partition with rows, named {prefix}_{i}_of_{n}.parquet."""
    spark, folder = df.sparkSession, f"{prefix}.{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().toString() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    names = [f"{prefix}_{i}_of_{len(parts)}.parquet" for i in range(len(parts))]
    for part, name in zip(parts, names):
        fs.delete(path(name), False)
        if not fs.rename(path(part), path(name)):
            raise OSError(f"cannot write {name}")
    fs.delete(path(folder), True)
    return names
