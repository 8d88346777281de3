"""Packing, unpacking and stacking, and aggregates that need two levels of grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import Agg
from .order import ORD


def _q(name: str):
    return F.col(f"`{name}`")


def two_level(df: DataFrame, keys: list[str], agg: Agg, name: str) -> DataFrame:
    """keys and name: counts by value, values at a rank, or sums and means by position, gathered once partial results are small."""
    cols, value = [_q(k) for k in keys], _q(agg.column)
    if agg.name == "frequency_count":
        counts = df.where(value.isNotNull()).groupBy(*cols, value.cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        return counts.groupBy(*cols).agg(F.map_from_entries(F.collect_list(F.struct("_v", "_n"))).alias(name))
    if agg.name == "quantile":
        # The rank's value is the least whose running count passes it: no group is gathered, equal values are one row.
        counts = df.where(value.isNotNull()).groupBy(*cols, value.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        all_ = counts.groupBy(*cols).agg(F.sum("_n").alias("_all")).toDF(*[f"_k_{k}" for k in keys], "_all")
        place = F.sum("_n").over(Window.partitionBy(*cols).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        match = reduce(lambda a, b: a & b, [_q(k).eqNullSafe(_q(f"_k_{k}")) for k in keys], F.lit(True))
        placed = counts.select("*", place.alias("_to")).join(F.broadcast(all_) if not keys else all_, match)
        reached = F.col("_to") > F.floor((F.col("_all") - 1) * agg.expression() + 0.5)
        return placed.groupBy(*cols).agg(F.min(F.when(reached, F.col("_v"))).alias(name))
    by_place = df.select(*cols, F.posexplode(value).alias("_p", "_x")).groupBy(*cols, "_p").agg(agg.build(F.col("_x")).alias("_x"))
    return by_place.groupBy(*cols).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias(name))


def pack(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The columns as one map, last, missing values kept; values of different types become text."""
    kinds = {df.schema[c].dataType for c in columns}
    entries = [x for c in columns for x in (F.lit(c), _q(c) if len(kinds) == 1 else _q(c).cast("string"))]
    return df.select("*", F.create_map(*entries).alias(name)).drop(*columns)


#: Columns that unpacking makes at most; more is an error, not a cut.
MOST_COLUMNS = 10_000


def unpack(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """One column for each key, in order of first appearance, or for each place, at most MOST_COLUMNS. Reads the keys once before."""
    kind = df.schema[column].dataType
    title = lambda k: f"{prefix}.{k}" if prefix else str(k)
    if isinstance(kind, T.MapType):
        at = F.col(ORD) if ORD in df.columns else F.monotonically_increasing_id()
        seen = df.select(at.alias("_o"), F.posexplode(F.map_keys(_q(column))).alias("_p", "_k")).groupBy("_k").agg(F.min(F.struct("_o", "_p")).alias("_f")).orderBy("_f")
        found = seen.limit(MOST_COLUMNS + 1).collect()  # the new schema
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} keys")
        new = [F.try_element_at(_q(column), F.lit(r["_k"])).alias(title(r["_k"])) for r in found]
    elif isinstance(kind, T.ArrayType):
        longest = df.agg(F.max(F.size(_q(column)))).first()[0] or 0
        if longest > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} places")
        new = [F.get(_q(column), F.lit(i)).alias(title(i)) for i in range(max(longest, 0))]
    else:
        raise TypeError(f"cannot unpack {kind.simpleString()}")
    return df.select(*[_q(c) for c in df.columns if c != column], *new)


def stack(df: DataFrame, column: str, name: str | list[str]) -> DataFrame:
    """One row for each element (for maps each entry, in two columns); none gives one row with missing."""
    others = [_q(c) for c in df.columns if c != column]
    kind = df.schema[column].dataType
    if isinstance(kind, T.MapType):
        names = [f"{name}.key", f"{name}.value"] if isinstance(name, str) else name
        return df.select(*others, F.explode_outer(_q(column)).alias(*names))
    if isinstance(kind, T.ArrayType):
        return df.select(*others, F.explode_outer(_q(column)).alias(name))
    raise TypeError(f"cannot stack {kind.simpleString()}")
