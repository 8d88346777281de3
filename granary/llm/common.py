"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; documents can hold 100 kB and more each.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Rows in a file of a table whose size is known before it is written.
FILE_ROWS = 100_000
#: Rows of a counted table of keys that are broadcast at most; beyond, the join is left to Spark. The result is the same.
BROADCAST_ROWS = 200_000


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows and bytes that a Python worker is sent at once. The settings stay, as results are computed later."""
    for key, most, usual in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", BATCH_BYTES, str(2**31 - 1))):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key, usual).rstrip("Bb")) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all is one process, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: later stages restart from the files, not from the lineage.

    rows: about how many there are, where that is known: the number of files follows it."""
    spark = session_of(df)
    path = new_path(spark, name)
    (df if rows is None else df.coalesce(-(-max(rows, 1) // FILE_ROWS))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables of cut() of which nothing is read any more."""
    for table in tables:
        spark = session_of(table)
        path = spark._jvm.org.apache.hadoop.fs.Path(table._granary_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checked(keys: DataFrame, rows: int) -> DataFrame:
    """keys, a table of few narrow columns with so many rows, marked for broadcast if they are few enough."""
    return F.broadcast(keys) if rows <= BROADCAST_ROWS else keys


class Cache(dict):
    """Remembers make(key); it starts afresh when full, so that memory stays bounded."""

    def __init__(self, make, most: int = 600_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
