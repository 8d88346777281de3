"""Aggregate specifications: each compiles to one expression of groupBy().agg()."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .order import ORD


@dataclass(frozen=True)
class Agg:
    """build(column) gives the expression; ordered ones need the ordinal."""

    name: str
    column: str | None
    build: Callable[[Column], Column]
    ordered: bool = False

    def expression(self) -> Column:
        return self.build(F.col(f"`{self.column}`") if self.column else F.lit(1))


def _agg(name: str, build: Callable[[Column], Column], ordered: bool = False) -> Callable[[str], Agg]:
    def make(column: str) -> Agg:
        return Agg(name, column, build, ordered)

    make.__name__ = name.upper()
    make.__doc__ = f"{name} of a column."
    return make


def COUNT(column: str | None = None) -> Agg:
    """Present values of a column; without one, rows."""
    return Agg("count", column, F.count)


def _listed(c: Column) -> Column:
    """All values in row order, missing ones too."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), c.alias("c")))), lambda x: x["c"])


def _nonzero(c: Column) -> Column:
    return c != 0


NON_NULL_COUNT = _agg("count", F.count)
SUM = _agg("sum", F.sum)
MEAN = AVG = _agg("mean", F.avg)
MIN = _agg("min", F.min)
MAX = _agg("max", F.max)
VARIANCE = _agg("variance", F.var_samp)
VAR_POP = _agg("var_pop", F.var_pop)
STD = STDV = _agg("std", F.stddev_samp)
STD_POP = _agg("std_pop", F.stddev_pop)
COUNT_DISTINCT = _agg("count_distinct", F.count_distinct)
CONCAT = ZIP_LIST = _agg("concat", _listed, ordered=True)
SELECT_ONE = _agg("select_one", lambda c: F.any_value(c, F.lit(True)))
COUNT_NA = _agg("count_na", lambda c: F.count_if(c.isNull()))
NNZ = _agg("nnz", lambda c: F.count_if(_nonzero(c)))
ANY = _agg("any", lambda c: F.coalesce(F.bool_or(_nonzero(c)), F.lit(False)).cast("long"))
ALL = _agg("all", lambda c: F.coalesce(F.bool_and(_nonzero(c)), F.lit(True)).cast("long"))
APPROX_COUNT_DISTINCT = _agg("approx_count_distinct", lambda c: F.approx_count_distinct(c, 0.016))
# These group on two levels, see reshape.two_level.
FREQ_COUNT = _agg("frequency_count", F.count)
VECTOR_SUM = _agg("vector_sum", F.sum)
VECTOR_AVG = _agg("vector_avg", F.avg)


def QUANTILE(column: str, q: float) -> Agg:
    """Exact nearest rank, as a float: the value at round((n - 1) q) of the sorted values, halves up. Found from counts by value, see reshape.two_level."""
    if not 0 <= q <= 1:
        raise ValueError("q must be between 0 and 1")
    return Agg("quantile", column, lambda c: F.lit(q))


@dataclass(frozen=True)
class Reducer:
    """A user's aggregate: start() gives a state, add(state, value) and merge(state, state) new ones, finish(state) the result. States are pickled between tasks."""

    start: Callable[[], object]
    add: Callable[[object, object], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object] = lambda state: state


def MEDIAN(column: str) -> Agg:
    return QUANTILE(column, 0.5)


def FREQUENT_ITEMS(column: str, k: int = 10) -> Agg:
    """About the k most frequent values and their counts, as a map of text to count."""

    def build(c: Column) -> Column:
        top = F.call_function("approx_top_k", c, F.lit(k), F.lit(max(1000, 8 * k)))
        return F.map_from_entries(F.transform(top, lambda x: F.struct(x["item"].cast("string"), x["count"])))

    return Agg("frequent_items", column, build)


#: Aggregates that need another level of grouping first.
TWO_LEVEL = {"frequency_count", "vector_sum", "vector_avg", "quantile"}
