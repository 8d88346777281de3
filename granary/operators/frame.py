"""Frame, the immutable table, and Series, the column bound to it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, datetime
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as text_
from ..functions import values
from ..types import DATETIME, DICT, FLOAT, INTEGER, LIST, SPARK, STRING, VECTOR, dtype, normalise, value_type
from . import reshape
from .aggregates import FREQUENT_ITEMS, QUANTILE, TWO_LEVEL, Agg, Reducer
from .order import ORD, ordering, with_ordinal


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


class Frame:
    """A lazy table: every operator returns a new one, nothing runs before an action."""

    def __init__(self, df: DataFrame, metadata: dict[str, str] | None = None):
        self._df, self.metadata = df, dict(metadata or {})

    # Building

    @classmethod
    def of(cls, df: DataFrame) -> Frame:
        return cls(normalise(df))

    @classmethod
    def from_rows(cls, spark: SparkSession, data: dict | list | None, schema: str | None = None) -> Frame:
        """From a dict of columns (of equal length), a list of dicts (keys missing somewhere become missing values), a pandas table, or nothing at all."""
        if data is None or isinstance(data, (dict, list)) and not data:
            return cls.of(spark.createDataFrame([], schema or T.StructType()))
        if hasattr(data, "iloc"):
            return cls.of(spark.createDataFrame(data, schema))
        if isinstance(data, dict):
            if any(isinstance(v, Series) for v in data.values()):
                return cls.from_columns(data)
            if len({len(v) for v in data.values()}) > 1:
                raise ValueError("columns differ in length")
            names, rows = list(data), list(zip(*data.values()))
        else:
            names = list(dict.fromkeys(k for row in data for k in row))
            rows = [tuple(row.get(n) for n in names) for row in data]
        if schema is None:
            schema = T.StructType([T.StructField(n, SPARK[kind_of(r[i] for r in rows)]) for i, n in enumerate(names)])
            rows = [tuple(None if x is None else MADE.get(value_type(f.dataType), lambda x: x)(x) for x, f in zip(r, schema)) for r in rows]
        return cls.of(spark.createDataFrame(rows, schema))

    @classmethod
    def from_columns(cls, columns: dict[str, Series]) -> Frame:
        """From columns of equal length, of one table or of several."""
        (name, first), *rest = columns.items()
        return reduce(lambda f, c: f.add_column(*c), rest, first.to_frame(name)) if any(not c.frame._is(first.frame) for _, c in rest) else Frame(first.frame._df.select(*[c.expr.alias(n) for n, c in columns.items()], *[ORD] * (ORD in first.frame._df.columns)))

    @classmethod
    def range(cls, spark: SparkSession, start: int, count: int, step: int = 1, name: str = "id") -> Frame:
        return cls(spark.range(start, start + step * count, step).toDF(name))

    @classmethod
    def constant(cls, spark: SparkSession, value: object, size: int, name: str = "value") -> Frame:
        return cls(spark.range(size).select(F.lit(value).alias(name)))

    def _new(self, df: DataFrame) -> Frame:
        return Frame(df)

    def _is(self, other: Frame) -> bool:
        """Whether expressions over the other hold for this one."""
        return self._df is other._df

    # Schema and access

    @property
    def df(self) -> DataFrame:
        return self._df.drop(ORD)

    @property
    def column_names(self) -> list[str]:
        return [c for c in self._df.columns if c != ORD]

    @property
    def dtypes(self) -> dict[str, str]:
        return {f.name: value_type(f.dataType) for f in self._df.schema if f.name != ORD}

    @property
    def num_columns(self) -> int:
        return len(self.column_names)

    num_cols = num_columns

    @property
    def column_types(self) -> list[str]:
        return list(self.dtypes.values())

    @property
    def schema(self) -> list[tuple[str, str]]:
        return list(self.dtypes.items())

    @property
    def size(self) -> int:
        return self.num_rows()

    def num_rows(self) -> int:
        return self._df.count()

    __len__ = num_rows

    @property
    def shape(self) -> tuple[int, int]:
        return self.num_rows(), self.num_columns

    def explain(self, mode: str = "formatted") -> None:
        self._df.explain(mode)

    def _check(self, *names: str) -> None:
        if missing := [n for n in names if n not in self.column_names]:
            raise KeyError(f"no column {missing[0]!r}")

    def __contains__(self, name: str) -> bool:
        return name in self.column_names

    def __getitem__(self, key):
        if isinstance(key, str):
            return self.column(key)
        if isinstance(key, list):
            return self.select(key)
        if isinstance(key, Series):
            return self.mask(key)
        if isinstance(key, slice):
            if key.step not in (None, 1):
                raise ValueError("steps other than 1")
            return self.slice(key.start or 0, key.stop)
        if isinstance(key, int):
            n = self.num_rows() if key < 0 else 0
            rows = self.slice(key + n, key + n + 1).to_list() if key + n >= 0 else []
            if not rows:
                raise IndexError(key)
            return rows[0]
        raise TypeError(type(key).__name__)

    def column(self, name: str) -> Series:
        self._check(name)
        return Series(self.copy(), _q(name), self.dtypes[name], name)  # a copy: columns stay as they are when this table is assigned to

    def __setitem__(self, name: str, col: Series | Column | object) -> None:
        """This table from now on, with the column set; a plain value fills it. Columns and tables taken before keep theirs."""
        self._df = self.set_column(name, col if isinstance(col, (Series, Column)) else F.lit(col).cast(SPARK[kind_of([col])]))._df

    def __delitem__(self, name: str) -> None:
        self._df = self.remove_columns(name)._df

    def select(self, names: list[str]) -> Frame:
        self._check(*names)
        return self._new(self._df.select(*map(_q, names), *[ORD] * (ORD in self._df.columns)))

    def with_metadata(self, **pairs: str) -> Frame:
        return Frame(self._df, self.metadata | pairs)

    def without_metadata(self, *names: str) -> Frame:
        return Frame(self._df, {k: v for k, v in self.metadata.items() if k not in names})

    def copy(self) -> Frame:
        return Frame(self._df, self.metadata)

    def materialize(self) -> Frame:
        df = self._df.persist()
        df.count()
        return Frame(df, self.metadata)

    # Mutation

    def _with(self, name: str, col: Series | Column) -> DataFrame:
        if isinstance(col, Column):
            return self._df.withColumn(name, col)
        if col.frame._is(self):
            return self._df.withColumn(name, col.expr)
        left, right = with_ordinal(self._df), with_ordinal(col.to_frame(ORD + "_value")._df)
        if left.count() != right.count():
            raise ValueError("columns differ in length")
        kept = left.drop(name) if name in left.columns else left
        return kept.join(right, ORD).withColumnRenamed(ORD + "_value", name)

    def add_column(self, name: str, col: Series | Column) -> Frame:
        if name in self:
            raise ValueError(f"column {name!r} exists")
        return self._new(self._with(name, col))

    def add_columns(self, cols: dict[str, Series | Column]) -> Frame:
        return reduce(lambda f, c: f.add_column(c, cols[c] if isinstance(cols[c], Column) or not cols[c].frame._is(self) else Series(f, cols[c].expr, cols[c].kind, c)), cols, self)

    def replace_column(self, name: str, col: Series | Column) -> Frame:
        self._check(name)
        return self._new(self._with(name, col)).select(self.column_names)

    def set_column(self, name: str, col: Series | Column) -> Frame:
        return self.replace_column(name, col) if name in self else self.add_column(name, col)

    def remove_columns(self, *names: str) -> Frame:
        self._check(*names)
        return self._new(self._df.drop(*names))

    remove_column = remove_columns

    def rename(self, names: dict[str, str]) -> Frame:
        self._check(*names)
        new = [names.get(c, c) for c in self._df.columns]
        if len(set(new)) < len(new) or any(v in self for v in names.values()):
            raise ValueError("names collide")
        return self._new(self._df.toDF(*new))

    def swap_columns(self, a: str, b: str) -> Frame:
        self._check(a, b)
        return self.select([{a: b, b: a}.get(c, c) for c in self.column_names])

    # Filters

    def filter(self, column: str, keep: Callable | Column) -> Frame:
        """keep: a condition (reaches the scan), or a function of one value whose exceptions count as False."""
        self._check(column)
        return self._new(self._df.where(keep if isinstance(keep, Column) else _predicate(keep)(_q(column))))

    def where(self, condition: Column) -> Frame:
        return self._new(self._df.where(condition))

    def mask(self, mask: Series) -> Frame:
        if mask.frame._is(self):
            return self._new(self._df.where(values.truth(mask.expr, mask.kind)))
        name = ORD + "_mask"
        zipped = self.add_column(name, mask)
        return self._new(zipped._df.where(values.truth(_q(name), mask.kind)).drop(name))

    def filter_by(self, members: list | Series, column: str, exclude: bool = False) -> Frame:
        """Rows whose value is among the members (or is not); missing may be one."""
        self._check(column)
        if isinstance(members, Series):
            right = members.frame._df.select(members.expr.alias("m")).distinct()
            return self._new(self._df.join(right, _q(column).eqNullSafe(F.col("m")), "left_anti" if exclude else "left_semi"))
        inside = _member(_q(column), members)
        return self._new(self._df.where(~inside if exclude else inside))

    # Joins

    def join(self, other: Frame, on: str | list[str] | dict[str, str], how: str = "inner") -> Frame:
        """Equi-join in which missing keys match; columns of the other side that clash get a suffix, keys of unmatched rows come from the side that has them."""
        pairs = {on: on} if isinstance(on, str) else dict(zip(on, on)) if isinstance(on, list) else on
        how = {"outer": "full", "full_outer": "full"}.get(how, how)
        if how not in ("inner", "left", "right", "full"):
            raise ValueError(f"unknown join {how!r}")
        self._check(*pairs)
        other._check(*pairs.values())
        left, right = self.df, other.df.toDF(*[f"_r_{c}" for c in other.column_names])
        match = reduce(lambda a, b: a & b, [left[f"`{a}`"].eqNullSafe(right[f"`_r_{b}`"]) for a, b in pairs.items()])
        taken = list(self.column_names)
        out = [(F.coalesce(_q(c), _q(f"_r_{pairs[c]}")) if c in pairs and how in ("right", "full") else _q(c)).alias(c) for c in taken]
        for c in other.column_names:
            if c not in pairs.values():
                name = c
                while name in taken:
                    name += ".1"
                taken.append(name)
                out.append(_q(f"_r_{c}").alias(name))
        return self._new(left.join(right, match, how).select(*out))

    # Grouping

    def groupby(self, keys: str | list[str], aggs: dict[str, Agg]) -> Frame:
        """Keys, then one column for each aggregate; row order is undefined."""
        keys = [keys] if isinstance(keys, str) else keys
        self._check(*keys, *[a.column for a in aggs.values() if a.column])
        df = with_ordinal(self._df) if any(a.ordered for a in aggs.values()) else self._df
        plain = {n: a for n, a in aggs.items() if a.name not in TWO_LEVEL}
        cols = list(map(_q, keys))
        if plain:
            out = df.groupBy(*cols).agg(*[a.expression().alias(n) for n, a in plain.items()])
        else:
            out = df.select(*cols).distinct() if keys else df.sparkSession.range(1).select()
        for name, agg in aggs.items():
            if agg.name in TWO_LEVEL:
                right = reshape.two_level(df, keys, agg, name).toDF(*[f"_r_{k}" for k in keys], name)
                match = reduce(lambda a, b: a & b, [_q(k).eqNullSafe(_q(f"_r_{k}")) for k in keys], F.lit(True))
                right = right if keys else F.broadcast(right)  # one row
                out = out.join(right, match, "left").drop(*[f"_r_{k}" for k in keys])
        return self._new(out.select(*cols, *map(_q, aggs)))

    def aggregate(self, aggs: dict[str, Agg]) -> Frame:
        """One row of aggregates; no table is scanned in order unless one of them is ordered."""
        return self.groupby([], aggs)

    def reduce_with(self, column: str, reducer: Reducer):
        """The result of a user's aggregate: each task reduces its values to one state, the states of all tasks are merged by tens."""
        self._check(column)

        def states(batches):
            state = reducer.start()
            for batch in batches:
                for value in batch.column(0).to_pylist():
                    state = reducer.add(state, value)
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(state)], pa.binary())], ["state"])

        def merged(batches):
            state = None
            for batch in batches:
                for x in map(cloudpickle.loads, batch.column(0).to_pylist()):
                    state = x if state is None else reducer.merge(state, x)
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(state)], pa.binary())], ["state"])

        made = self._df.select(_q(column)).mapInArrow(states, "state binary")
        tasks = self._df.rdd.getNumPartitions()
        while tasks > 10:
            tasks = -(-tasks // 10)
            made = made.repartition(tasks).mapInArrow(merged, "state binary")
        found = [cloudpickle.loads(r["state"]) for r in made.collect()]  # at most ten
        return reducer.finish(reduce(reducer.merge, found) if found else reducer.start())

    def apply_rows(self, f: Callable, columns: dict[str, object]) -> Frame:
        """The columns that f makes of each row (a dict), in Arrow batches; f gives a sequence, in the order of columns. What it fails on is missing."""
        kinds = {c: dtype(t) for c, t in columns.items()}
        names = self.column_names

        def run(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    try:
                        made = tuple(f(row))
                    except Exception:
                        made = ()
                    out.append([MADE.get(k, lambda x: x)(x) if x is not None else None for k, x in zip(kinds.values(), made)] if len(made) == len(kinds) else [None] * len(kinds))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(arrow)], list(kinds))

        schema = T.StructType([T.StructField(c, SPARK[k]) for c, k in kinds.items()])
        arrow = [to_arrow_type(x.dataType) for x in schema]
        return self._new(self._df.select(*map(_q, names)).mapInArrow(run, schema))

    def unique(self) -> Frame:
        return self._new(self.df.groupBy(*map(_q, self.column_names)).agg(F.lit(1).alias(ORD)).drop(ORD))

    # Order

    def sort(self, keys: str | list, ascending: bool = True) -> Frame:
        """keys: a name, names, or (name, ascending) pairs; missing last upwards, first downwards."""
        pairs = [(k, ascending) if isinstance(k, str) else tuple(k) for k in ([keys] if isinstance(keys, str) else keys)]
        self._check(*[k for k, _ in pairs])
        return self._new(self._df.drop(ORD).orderBy(*ordering(pairs)))

    def topk(self, column: str, k: int = 10, reverse: bool = False) -> Frame:
        """The k greatest (least, if reversed); missing counts as greatest."""
        return self._new(self.df.orderBy(*ordering([(column, reverse)])).limit(k))

    def head(self, n: int = 10) -> Frame:
        return self._new(self._df.limit(n)) if ORD not in self._df.columns else self.slice(0, n)

    def tail(self, n: int = 10) -> Frame:
        df = with_ordinal(self._df)
        return self._new(df.orderBy(F.desc(ORD)).limit(n).orderBy(ORD))

    def slice(self, start: int, stop: int | None = None) -> Frame:
        df = with_ordinal(self._df)
        if start < 0 or (stop or 0) < 0:
            n = df.count()
            start, stop = start + n * (start < 0), stop if stop is None else stop + n * (stop < 0)
        inside = F.col(ORD) >= start
        df = df.where(inside if stop is None else inside & (F.col(ORD) < stop)).orderBy(ORD)
        return Frame(df.withColumn(ORD, F.col(ORD) - start), self.metadata)

    def add_row_number(self, name: str = "id", start: int = 0, order_by: list | None = None) -> Frame:
        """Row numbers as the first column; with order_by, in that order."""
        if name in self:
            raise ValueError(f"column {name!r} exists")
        if order_by:
            keys = [(k, True) if isinstance(k, str) else tuple(k) for k in order_by]
            df = with_ordinal(self.df.orderBy(*ordering(keys)))
        else:
            df = with_ordinal(self._df)
        return self._new(df.select((F.col(ORD) + start).alias(name), *map(_q, self.column_names), ORD))

    def append(self, *others: Frame) -> Frame:
        """The rows of this table, then those of the others, which need the same names and types."""
        for other in others:
            if self.column_names != other.column_names or self.dtypes != other.dtypes:
                raise ValueError("tables differ in names or types")
        return self._new(reduce(DataFrame.unionAll, [other.df for other in others], self.df))

    def _chosen(self, fraction: float, seed: int, key: list[str] | None) -> tuple[DataFrame, Column]:
        df = self._df if key else with_ordinal(self._df)
        parts = [_q(k).cast("string") for k in key] if key else [F.col(ORD).cast("string")]
        draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *parts))), 1, 8), 16, 10).cast("long")
        return df, draw < int(fraction * 2**32)

    def sample(self, fraction: float, seed: int = 42, key: list[str] | None = None) -> Frame:
        """Rows whose hash of seed and row number (or key columns) is below the fraction: the same however rows are dealt."""
        df, chosen = self._chosen(fraction, seed, key)
        return self._new(df.where(chosen))

    def random_split(self, fraction: float, seed: int = 42, key: list[str] | None = None) -> tuple[Frame, Frame]:
        df, chosen = self._chosen(fraction, seed, key)
        return self._new(df.where(chosen)), self._new(df.where(~chosen))

    # Missing values

    def fillna(self, column: str, value: object) -> Frame:
        return self.replace_column(column, self.column(column).fillna(value))

    def _clean(self, columns: list[str] | str | None, how: str) -> Column:
        if how not in ("any", "all"):
            raise ValueError(f"how must be any or all, not {how!r}")
        names = self.column_names if columns is None else [columns] if isinstance(columns, str) else columns
        self._check(*names)
        return reduce((lambda a, b: a & b) if how == "any" else (lambda a, b: a | b), [_q(c).isNotNull() for c in names])

    def dropna(self, columns: list[str] | str | None = None, how: str = "any") -> Frame:
        return self._new(self._df.where(self._clean(columns, how)))

    def dropna_split(self, columns: list[str] | str | None = None, how: str = "any") -> tuple[Frame, Frame]:
        clean = self._clean(columns, how)
        return self._new(self._df.where(clean)), self._new(self._df.where(~clean))

    # Shape

    def pack_columns(self, columns: list[str], name: str) -> Frame:
        self._check(*columns)
        return self._new(reshape.pack(self._df, columns, name))

    def unpack_column(self, column: str, prefix: str | None = None) -> Frame:
        self._check(column)
        return self._new(reshape.unpack(self._df, column, column if prefix is None else prefix))

    def stack(self, column: str, name: str | list[str]) -> Frame:
        self._check(column)
        return self._new(reshape.stack(self._df, column, name).drop(ORD))

    # Actions

    def _rows(self) -> DataFrame:
        return self._df.orderBy(ORD).drop(ORD) if ORD in self._df.columns else self._df

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._rows().collect()]

    def iter_rows(self, prefetch: bool = True) -> Iterator[dict]:
        """Rows one by one, the next partition fetched meanwhile."""
        return (r.asDict(recursive=True) for r in self._rows().toLocalIterator(prefetchPartitions=prefetch))

    __iter__ = iter_rows

    def iter_batches(self, rows: int = 4_096) -> Iterator[list[dict]]:
        """Rows by lists of at most so many, the next partition fetched meanwhile."""
        found = self.iter_rows()
        while batch := list(islice(found, rows)):
            yield batch

    def print_rows(self, n: int = 10, width: int = 30) -> None:
        self._rows().show(n, width)

    def to_pandas(self):
        return self._rows().toPandas()

    # Sinks

    def save(self, path: str) -> None:
        from ..sources import native

        native.save(self, path)

    def to_parquet(self, path: str, sharded: bool = True) -> None:
        (self.df if sharded else self.df.coalesce(1)).write.mode("overwrite").parquet(path)

    def to_parquet_sharded(self, prefix: str) -> list[str]:
        """One file for each partition that has rows, {prefix}_{i}_of_{n}.parquet; their paths."""
        from ..sources import parquet

        return parquet.write_sharded(self.df, prefix)

    def to_csv(self, path: str, **options) -> None:
        from ..sources import csv

        csv.write(self, path, **options)

    def to_json(self, path: str) -> None:
        from ..sources import json

        json.write(self, path)


def _predicate(f: Callable):
    def safe(x):
        try:
            return bool(f(x))
        except Exception:
            return False

    return F.udf(safe, T.BooleanType(), useArrow=True)


def kind_of(values_) -> str:
    """The type of plain values: that of the first present one; integers beside floats are floats."""
    present = [x for x in values_ if x is not None]
    if not present:
        return INTEGER
    first = present[0]
    if isinstance(first, (bool, int)):
        return FLOAT if any(isinstance(x, float) for x in present) else INTEGER
    if isinstance(first, (list, tuple)):
        return VECTOR if all(isinstance(x, (int, float)) for v in present for x in v) else LIST
    found = next((k for t, k in ((float, FLOAT), (str, STRING), (dict, DICT), (datetime, DATETIME), (date, DATETIME)) if isinstance(first, t)), None)
    if found is None:
        raise TypeError(f"no type for {type(first).__name__}")
    return found


def _plain(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)


#: How plain values of a type are made fit for Spark.
MADE = {INTEGER: int, FLOAT: float, STRING: str, VECTOR: lambda v: list(map(float, v)), LIST: lambda v: list(map(_plain, v)), DICT: lambda v: {str(k): _plain(x) for k, x in v.items()}}


def _member(c: Column, members: list) -> Column:
    present = [m for m in members if m is not None]
    inside = F.coalesce(c.isin(present), F.lit(False)) if present else F.lit(False)
    return inside | c.isNull() if None in members else inside


class Series:
    """A lazy column: an expression over one Frame."""

    def __init__(self, frame: Frame, expr: Column, kind: str, name: str = "value"):
        self.frame, self.expr, self.kind, self.name = frame, expr, kind, name

    @classmethod
    def of(cls, spark: SparkSession, data: list, kind: str | None = None) -> Series:
        kind = dtype(kind) if kind is not None else kind_of(data)
        made = MADE.get(kind, lambda x: x)
        schema = T.StructType([T.StructField("value", T.StringType() if kind == "undefined" else SPARK[kind])])
        df = spark.createDataFrame([(None if x is None else made(x),) for x in data], schema)
        return Frame(df)["value"]

    @classmethod
    def range(cls, spark: SparkSession, start: int, count: int, step: int = 1) -> Series:
        return Frame.range(spark, start, count, step, "value")["value"]

    @classmethod
    def constant(cls, spark: SparkSession, value: object, size: int) -> Series:
        return Frame.constant(spark, value, size)["value"]

    @property
    def shape(self) -> tuple[int]:
        return (len(self),)

    @property
    def size(self) -> int:
        return len(self)

    def __repr__(self) -> str:
        return f"Series(name={self.name!r}, dtype={self.kind!r})"

    def print_rows(self, n: int = 10, width: int = 30) -> None:
        self.to_frame().print_rows(n, width)

    def explain(self, mode: str = "formatted") -> None:
        self.to_frame().explain(mode)

    def materialize(self) -> Series:
        return self.to_frame("value").materialize()["value"]

    @property
    def dtype(self) -> str:
        return self.kind

    def _new(self, expr: Column, kind: str | None = None) -> Series:
        return Series(self.frame, expr, kind or self.kind, self.name)

    def to_frame(self, name: str | None = None) -> Frame:
        kept = [ORD] * (ORD in self.frame._df.columns)
        return Frame(self.frame._df.select(self.expr.alias(name or self.name), *kept))

    def __bool__(self):
        raise ValueError("the truth of a whole column is undefined; use any() or all()")

    def __len__(self) -> int:
        return self.frame.num_rows()

    # Operators

    def _other(self, other: object) -> tuple[Series, Column, str]:
        """self, the other's expression and its type, over one frame."""
        if isinstance(other, Series):
            if other.frame._is(self.frame):
                return self, other.expr, other.kind
            a, b = "a" + ORD, "b" + ORD
            zipped = self.to_frame(a).add_column(b, Series(other.to_frame(b), _q(b), other.kind, b))
            return Series(zipped, _q(a), self.kind, self.name), _q(b), other.kind
        if isinstance(other, (list, tuple)):
            return self, F.array(*[F.lit(float(x)) for x in other]), VECTOR
        kind = INTEGER if isinstance(other, (bool, int)) else FLOAT if isinstance(other, float) else STRING if isinstance(other, str) else self.kind
        return self, F.lit(int(other) if isinstance(other, bool) else other).cast(SPARK[kind]) if kind in (INTEGER, FLOAT) else F.lit(other), kind

    def _arith(self, op: str, other: object, reflected: bool = False) -> Series:
        me, expr, kind = self._other(other)
        out = values.arithmetic(op, *((expr, kind, me.expr, me.kind) if reflected else (me.expr, me.kind, expr, kind)))
        return me._new(*out)

    def _compare(self, f: Callable, other: object) -> Series:
        me, expr, _ = self._other(other)
        return me._new(f(me.expr, expr), INTEGER)

    def __add__(self, o):
        return self._arith("+", o)

    def __radd__(self, o):
        return self._arith("+", o, True)

    def __sub__(self, o):
        return self._arith("-", o)

    def __rsub__(self, o):
        return self._arith("-", o, True)

    def __mul__(self, o):
        return self._arith("*", o)

    def __rmul__(self, o):
        return self._arith("*", o, True)

    def __truediv__(self, o):
        return self._arith("/", o)

    def __rtruediv__(self, o):
        return self._arith("/", o, True)

    def __mod__(self, o):
        return self._arith("%", o)

    def __rmod__(self, o):
        return self._arith("%", o, True)

    def __floordiv__(self, o):
        return self._arith("//", o)

    def __rfloordiv__(self, o):
        return self._arith("//", o, True)

    def __pow__(self, o):
        return self._arith("**", o)

    def __rpow__(self, o):
        return self._arith("**", o, True)

    def __neg__(self):
        return self._new(-self.expr)

    def __pos__(self):
        return self

    def __abs__(self):
        return self._new(F.abs(self.expr) if self.kind in (INTEGER, FLOAT) else F.lit(None))

    abs = __abs__

    def __eq__(self, o):
        return self._compare(values.eq, o)

    def __ne__(self, o):
        return self._compare(values.ne, o)

    def __lt__(self, o):
        return self._compare(values.lt, o)

    def __le__(self, o):
        return self._compare(values.le, o)

    def __gt__(self, o):
        return self._compare(values.gt, o)

    def __ge__(self, o):
        return self._compare(values.ge, o)

    def __and__(self, o):
        return self._compare(values.both, o)

    def __or__(self, o):
        return self._compare(values.either, o)

    __hash__ = None

    # Elementwise

    def astype(self, kind: object) -> Series:
        to = dtype(kind)
        return self._new(values.cast(self.expr, self.kind, to), to)

    def clip(self, low: object = None, high: object = None) -> Series:
        return self._new(values.clip(self.expr, low, high))

    def clip_lower(self, low: object) -> Series:
        return self.clip(low=low)

    def clip_upper(self, high: object) -> Series:
        return self.clip(high=high)

    def fillna(self, value: object) -> Series:
        _, expr, kind = self._other(value)
        if kind != self.kind and {kind, self.kind} != {INTEGER, FLOAT}:
            raise TypeError(f"cannot fill {self.kind} with {kind}")
        return self._new(F.coalesce(self.expr, expr.cast(SPARK[self.kind])))

    def is_na(self) -> Series:
        return self._new(self.expr.isNull().cast("long"), INTEGER)

    def is_in(self, members: list | Series) -> Series:
        """1 for values among the members, missing too if it is one; members may be a column, however long, which is joined to this one."""
        if not isinstance(members, Series):
            return self._new(_member(self.expr, members).cast("long"), INTEGER)
        mine, there = ORD + "_value", ORD + "_member"
        found = members.frame._df.select(members.expr.alias(there)).distinct().withColumn(ORD + "_found", F.lit(1))
        left = self.frame._df.withColumn(mine, self.expr)
        joined = Frame(left.join(found, F.col(mine).eqNullSafe(F.col(there)), "left").drop(mine, there))
        return Series(joined, F.coalesce(F.col(ORD + "_found"), F.lit(0)).cast("long"), INTEGER, self.name)

    def __contains__(self, value: object) -> bool:
        return bool(self.frame._df.where(self.expr.eqNullSafe(F.lit(value))).limit(1).count())

    def apply(self, f: Callable, kind: object = None) -> Series:
        """f of each value in Arrow batches; exceptions and results of another type are missing."""
        to = dtype(kind or self.kind)
        made = {INTEGER: int, FLOAT: (int, float), STRING: str, VECTOR: (list, tuple), LIST: list, DICT: dict}.get(to, object)

        def safe(x):
            try:
                out = f(x)
            except Exception:
                return None
            return (float(out) if to == FLOAT else out) if isinstance(out, made) else None

        return self._new(F.udf(safe, SPARK[to], useArrow=True)(self.expr), to)

    def filter(self, keep: Callable | Series) -> Series:
        frame = self.to_frame("value")
        if isinstance(keep, Series) and keep.frame._is(self.frame):
            return Frame(self.frame._df.where(values.truth(keep.expr, keep.kind)).select(self.expr.alias("value")))["value"]
        return frame.mask(keep)["value"] if isinstance(keep, Series) else frame.filter("value", keep)["value"]

    def __getitem__(self, key):
        if isinstance(key, Series):
            return self.filter(key)
        return self.to_frame("value")[key]["value"]

    def dropna(self) -> Series:
        return self.to_frame("value").dropna()["value"]

    def contains(self, part: str) -> Series:
        return self._new(text_.contains(self.expr, part) if self.kind == STRING else F.lit(0).cast("long"), INTEGER)

    def count_bag_of_words(self, to_lower: bool = True) -> Series:
        return self._new(text_.bag_of_words(self.expr, to_lower), DICT)

    def count_ngrams(self, n: int = 2, to_lower: bool = True) -> Series:
        return self._new(text_.word_ngrams(self.expr, n, to_lower), DICT)

    def count_character_ngrams(self, n: int = 2, to_lower: bool = True) -> Series:
        return self._new(text_.char_ngrams(self.expr, n, to_lower), DICT)

    def dict_keys(self) -> Series:
        return self._new(F.map_keys(self.expr), LIST)

    def dict_values(self) -> Series:
        return self._new(F.map_values(self.expr), LIST)

    def dict_trim_by_keys(self, keys: list, exclude: bool = True) -> Series:
        return self._new(text_.trim_by_keys(self.expr, keys, exclude))

    def dict_trim_by_values(self, low: object = None, high: object = None) -> Series:
        return self._new(text_.trim_by_values(self.expr, low, high))

    def dict_has_any_keys(self, keys: list) -> Series:
        return self._new(text_.has_any_key(self.expr, keys) if self.kind == DICT else F.lit(0).cast("long"), INTEGER)

    def dict_has_all_keys(self, keys: list) -> Series:
        return self._new(text_.has_all_keys(self.expr, keys) if self.kind == DICT else F.lit(0).cast("long"), INTEGER)

    def item_length(self) -> Series:
        return self._new(text_.item_length(self.expr, self.kind), INTEGER)

    def vector_slice(self, start: int, end: int | None = None) -> Series:
        return self._new(text_.vector_slice(self.expr, start, end))

    # Windows

    def rolling(self, how: str, before: int, after: int, min_observations: int = 0, order_by: str | None = None, partition_by: list[str] | None = None) -> Series:
        """sum, mean, min, max, count, var or std of the rows from `before` above to `after` below, missing skipped; fewer than min_observations give missing. Without partition_by all rows form one window in one task."""
        frame = self.frame if order_by else Frame(with_ordinal(self.frame._df))
        spec = (Window.partitionBy(*map(_q, partition_by)) if partition_by else Window).orderBy(_q(order_by) if order_by else F.col(ORD)).rowsBetween(-before, after)
        f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "var": F.var_samp, "std": F.stddev_samp}[how]
        out = f(self.expr).over(spec)
        if how == "sum":
            out = F.coalesce(out, F.lit(0).cast("long") if self.kind == INTEGER else F.lit(0.0))
        kind = INTEGER if how == "count" else self.kind if how in ("sum", "min", "max") else FLOAT
        return Series(frame, F.when(F.count(self.expr).over(spec) >= min_observations, out), kind, self.name)

    def rolling_sum(self, before: int, after: int, min_observations: int = 0, **kw) -> Series:
        return self.rolling("sum", before, after, min_observations, **kw)

    def rolling_mean(self, before: int, after: int, min_observations: int = 0, **kw) -> Series:
        return self.rolling("mean", before, after, min_observations, **kw)

    def rolling_min(self, before: int, after: int, min_observations: int = 0, **kw) -> Series:
        return self.rolling("min", before, after, min_observations, **kw)

    def rolling_max(self, before: int, after: int, min_observations: int = 0, **kw) -> Series:
        return self.rolling("max", before, after, min_observations, **kw)

    # Whole column

    def _reduce(self, expr: Column):
        return self.frame._df.agg(expr.alias("r")).first()["r"]

    def sum(self):
        return self._reduce(F.sum(self.expr))

    def mean(self):
        return self._reduce(F.avg(self.expr))

    def min(self):
        return self._reduce(F.min(self.expr))

    def max(self):
        return self._reduce(F.max(self.expr))

    def var(self, ddof: int = 0):
        return self._reduce((F.var_samp if ddof else F.var_pop)(self.expr))

    def std(self, ddof: int = 0):
        return self._reduce((F.stddev_samp if ddof else F.stddev_pop)(self.expr))

    def any(self) -> bool:
        return bool(self._reduce(F.coalesce(F.bool_or(values.truth(self.expr, self.kind)), F.lit(False))))

    def all(self) -> bool:
        return bool(self._reduce(F.coalesce(F.bool_and(F.when(self.expr.isNotNull(), values.truth(self.expr, self.kind))), F.lit(True))))

    def nnz(self) -> int:
        return self._reduce(F.count_if(self.expr != 0))

    def num_missing(self) -> int:
        return self._reduce(F.count_if(self.expr.isNull()))

    countna = num_missing

    def approx_count_distinct(self) -> int:
        return self._reduce(F.approx_count_distinct(self.expr, 0.016))

    def frequent_items(self, k: int = 10) -> dict:
        """About the k most frequent values, as text, and their counts."""
        return self.to_frame("value").aggregate({"r": FREQUENT_ITEMS("value", k)}).df.first()["r"] or {}

    def quantile(self, q: float) -> float | None:
        return self.to_frame("value").aggregate({"r": QUANTILE("value", q)}).df.first()["r"]

    def median(self) -> float | None:
        return self.quantile(0.5)

    def reduce_with(self, reducer: Reducer):
        return self.to_frame("value").reduce_with("value", reducer)

    def reductions(self) -> dict:
        """All the numbers above of a column of numbers, from one scan."""
        c = self.expr
        aggs = {"sum": F.sum(c), "mean": F.avg(c), "min": F.min(c), "max": F.max(c), "var": F.var_pop(c), "std": F.stddev_pop(c), "nnz": F.count_if(c != 0), "num_missing": F.count_if(c.isNull())}
        aggs |= {"any": F.coalesce(F.bool_or(values.truth(c, self.kind)), F.lit(False)), "all": F.coalesce(F.bool_and(F.when(c.isNotNull(), values.truth(c, self.kind))), F.lit(True))}
        return self.frame._df.agg(*[e.alias(n) for n, e in aggs.items()]).first().asDict()

    def sketch_summary(self):
        from .sketch import summary

        return summary(self)

    def unique(self) -> Series:
        return self.to_frame("value").unique()["value"]

    def sort(self, ascending: bool = True) -> Series:
        return self.to_frame("value").sort("value", ascending)["value"]

    def append(self, other: Series) -> Series:
        return self.to_frame("value").append(other.to_frame("value"))["value"]

    def head(self, n: int = 10) -> Series:
        return self.to_frame("value").head(n)["value"]

    def tail(self, n: int = 10) -> Series:
        return self.to_frame("value").tail(n)["value"]

    def sample(self, fraction: float, seed: int = 42) -> Series:
        return self.to_frame("value").sample(fraction, seed)["value"]

    def random_split(self, fraction: float, seed: int = 42) -> tuple[Series, Series]:
        one, two = self.to_frame("value").random_split(fraction, seed)
        return one["value"], two["value"]

    def to_list(self) -> list:
        return [r["value"] for r in self.to_frame("value").to_list()]

    def __iter__(self):
        return (r["value"] for r in self.to_frame("value").iter_rows())
