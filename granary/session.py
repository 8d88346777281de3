"""Session factory and the settings the engine relies on."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

#: ANSI mode stays on: overflow raises, and try_ functions stand where the engine wants a missing value.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one; conf keys use __ for dots."""
    builder = SparkSession.builder.appName("granary")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# The suffixes of sizes.
UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "kib": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "mib": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "gib": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "tib": 1 << 40}
#: The engine's knobs and the settings of the session that they stand for; Spark sizes sorts, joins, groups and caches by itself.
KNOBS = {"batch_rows": "spark.sql.execution.arrow.maxRecordsPerBatch", "batch_bytes": "spark.sql.execution.arrow.maxBytesPerBatch", "split_bytes": "spark.sql.files.maxPartitionBytes", "broadcast_bytes": "spark.sql.autoBroadcastJoinThreshold", "shuffle_partitions": "spark.sql.shuffle.partitions", "partition_bytes": "spark.sql.adaptive.advisoryPartitionSizeInBytes"}


def size(text: str | int) -> int:
    """A number of bytes, with or without a unit: 64, 64k, 1.5 GiB."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]*)\s*", str(text).lower())
    if not found or found[2] not in UNITS:
        raise ValueError(f"no size: {text!r}")
    return int(float(found[1]) * UNITS[found[2]])


def configure(spark: SparkSession, **knobs: str | int) -> dict[str, int]:
    """Sets knobs of the running session, by name or by the environment (GRANARY_BATCH_ROWS and so on, where not named); what holds now."""
    for name, key in KNOBS.items():
        if (value := knobs.pop(name, os.environ.get(f"GRANARY_{name.upper()}"))) is not None:
            spark.conf.set(key, str(size(value)))
    if knobs:
        raise ValueError(f"unknown knob {next(iter(knobs))!r}; known are {', '.join(KNOBS)}")
    return {name: size(spark.conf.get(key)) for name, key in KNOBS.items()}
