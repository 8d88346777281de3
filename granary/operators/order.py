"""Row order: a hidden ordinal that exists only where an operator depends on order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORD = "_granary_ord"
_BITS = 33  # monotonically_increasing_id holds the partition above them


def with_ordinal(df: DataFrame) -> DataFrame:
    """df with contiguous ordinals in physical order: one count of rows per partition, no shuffle.

    Where a shuffle stands below, two runs may deal rows differently; the tagged rows are then kept first, in the
    checkpoint folder if there is one, else by persist(), so that the counts are of the rows that are numbered."""
    if ORD in df.columns:
        return df
    tagged = df.withColumn(ORD, F.monotonically_increasing_id())
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        tagged = tagged.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else tagged.persist()
    part = F.shiftrightunsigned(F.col(ORD), _BITS)
    counts = {r["p"]: r["n"] for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    if not counts:
        return tagged
    starts, total = [], 0
    for p in range(max(counts) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    held = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")  # one literal, however many partitions there are
    return tagged.withColumn(ORD, F.element_at(held, part.cast("int") + 1) + F.col(ORD).bitwiseAND((1 << _BITS) - 1))


def ordering(keys: list[tuple[str, bool]]) -> list:
    """Missing last upwards, first downwards."""
    return [F.col(f"`{c}`").asc_nulls_last() if up else F.col(f"`{c}`").desc_nulls_first() for c, up in keys]
