"""One-pass summary of a column from Spark's own sketches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..types import DATETIME, FLOAT, INTEGER, STRING


@dataclass
class Summary:
    size: int
    num_undefined: int
    num_unique: int
    min: object = None
    max: object = None
    sum: object = None
    mean: float | None = None
    var: float = 0.0
    std: float = 0.0
    frequent_items: dict = field(default_factory=dict)
    quantiles: list[float] = field(default_factory=list)

    def quantile(self, q: float) -> float | None:
        """The value at the nearest of 201 evenly spaced ranks."""
        return self.quantiles[round(q * (len(self.quantiles) - 1))] if self.quantiles else None

    def frequency_count(self, value: object) -> int:
        return self.frequent_items.get(str(value), 0)


def summary(column, accuracy: int = 200, items: int = 128) -> Summary:
    """All statistics in one aggregation; rank error 1 / accuracy."""
    c, kind = column.expr, column.kind
    aggs = [F.count(F.lit(1)).alias("size"), F.count_if(c.isNull()).alias("num_undefined")]
    if kind in (INTEGER, FLOAT, STRING, DATETIME):
        aggs += [F.approx_count_distinct(c, 0.016).alias("num_unique"), F.call_function("approx_top_k", c, F.lit(items), F.lit(4096)).alias("items")]
    if kind in (INTEGER, FLOAT):
        aggs += [F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias("var")]
        aggs.append(F.percentile_approx(c.cast("double"), [i / 200 for i in range(201)], accuracy * 5).alias("quantiles"))
    row = column.frame._df.agg(*aggs).first().asDict()
    found = {str(x["item"]): x["count"] for x in row.pop("items", None) or []}
    out = Summary(**{"num_unique": 0} | {k: v for k, v in row.items() if v is not None}, frequent_items=found)
    out.std = out.var**0.5
    return out
