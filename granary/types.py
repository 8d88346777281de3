"""The eight value types, their Spark types, and the normaliser that maps any table onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, STRING, VECTOR, LIST, DICT, DATETIME, UNDEFINED = "integer", "float", "string", "vector", "list", "dict", "datetime", "undefined"
# Names that users may give for a type.
ALIASES = {"int": INTEGER, "str": STRING, "array": VECTOR, "double": FLOAT, "long": INTEGER} | {t: t for t in (INTEGER, FLOAT, STRING, VECTOR, LIST, DICT, DATETIME, UNDEFINED)}
SPARK = {INTEGER: T.LongType(), FLOAT: T.DoubleType(), STRING: T.StringType(), VECTOR: T.ArrayType(T.DoubleType(), False), LIST: T.ArrayType(T.StringType()), DICT: T.MapType(T.StringType(), T.StringType()), DATETIME: T.TimestampType(), UNDEFINED: T.VariantType()}
_INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)
_FLOATS = (T.DoubleType, T.FloatType)


def dtype(name: object) -> str:
    """The type that a name or a Python type stands for."""
    name = {int: INTEGER, float: FLOAT, str: STRING, list: LIST, dict: DICT}.get(name, name)
    if name not in ALIASES:
        raise ValueError(f"unknown type {name!r}")
    return ALIASES[name]


def value_type(t: T.DataType) -> str:
    """The engine's type of a Spark type; ValueError for those it does not hold."""
    if isinstance(t, _INTEGERS):
        return INTEGER
    if isinstance(t, _FLOATS):
        return FLOAT
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(t, T.ArrayType):
        return VECTOR if isinstance(t.elementType, (*_FLOATS, *_INTEGERS)) else LIST
    if isinstance(t, (T.MapType, T.StructType)):
        return DICT
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(t, (T.VariantType, T.NullType)):
        return UNDEFINED
    raise ValueError(f"unsupported type {t.simpleString()}")


def normalised(c: Column, t: T.DataType) -> Column:
    """c widened to the engine's physical type; unchanged where it has it, so that predicates still reach the scan."""
    kind = value_type(t)
    if kind == VECTOR and t != SPARK[VECTOR]:
        return c.cast("array<double>")
    if kind in (INTEGER, FLOAT, DATETIME) and t != SPARK[kind]:
        return c.cast(SPARK[kind])
    if isinstance(t, T.StructType):
        return F.from_json(F.to_json(c), T.MapType(T.StringType(), T.StringType()))
    return c


def normalise(df: DataFrame) -> DataFrame:
    return df.select([normalised(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
