"""Arithmetic, comparison and casts with the engine's rules for missing values.

Missing equals itself and is greater than everything; comparisons give 0 or 1; dividing or taking remainders by integer
zero gives missing, by float zero the IEEE result. All are built-in expressions, so whole-stage code generation holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DATETIME, DICT, FLOAT, INTEGER, LIST, SPARK, STRING, VECTOR
from .parser import parse

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


def as01(c: Column) -> Column:
    return c.cast("long")


def eq(a: Column, b: Column) -> Column:
    return as01(a.eqNullSafe(b))


def ne(a: Column, b: Column) -> Column:
    return as01(~a.eqNullSafe(b))


def gt(a: Column, b: Column) -> Column:
    return as01(F.when(b.isNull(), F.lit(False)).when(a.isNull(), F.lit(True)).otherwise(a > b))


def ge(a: Column, b: Column) -> Column:
    return as01(F.when(a.isNull(), F.lit(True)).when(b.isNull(), F.lit(False)).otherwise(a >= b))


def lt(a: Column, b: Column) -> Column:
    return gt(b, a)


def le(a: Column, b: Column) -> Column:
    return ge(b, a)


def truth(c: Column, kind: str) -> Column:
    """Whether a mask keeps a row: non-zero numbers, any present value of other types."""
    return F.coalesce(c != 0, F.lit(False)) if kind in (INTEGER, FLOAT) else c.isNotNull()


def both(a: Column, b: Column) -> Column:
    return as01((F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0))


def either(a: Column, b: Column) -> Column:
    return as01((F.coalesce(a, F.lit(0)) != 0) | (F.coalesce(b, F.lit(0)) != 0))


def ieee_div(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(a / b)


def _sized(a: Column, b: Column, f) -> Column:
    """Element-wise where the lengths match, else missing."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def arithmetic(op: str, a: Column, ka: str, b: Column, kb: str) -> tuple[Column, str]:
    """Result and type of a op b for + - * / % // **."""
    if VECTOR in (ka, kb):
        simple = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": ieee_div}[op]
        if ka == kb:
            return _sized(a, b, simple), VECTOR
        if ka == VECTOR and op in "*/":
            return F.when(b.isNotNull(), F.transform(a, lambda x: simple(x, b.cast("double")))), VECTOR
        if kb == VECTOR and op == "*":
            return F.when(a.isNotNull(), F.transform(b, lambda x: a.cast("double") * x)), VECTOR
        raise TypeError(f"{ka} {op} {kb}")
    if op == "+" and ka == kb == STRING:
        return F.concat(a, b), STRING
    if not {ka, kb} <= {INTEGER, FLOAT}:
        raise TypeError(f"{ka} {op} {kb}")
    whole = ka == kb == INTEGER
    if op in ("+", "-", "*"):
        out = {"+": a + b, "-": a - b, "*": a * b}[op]
        return out, INTEGER if whole else FLOAT
    if op == "/":
        return (F.try_divide(a, b), FLOAT) if whole else (ieee_div(a, b), FLOAT)
    if op == "%":
        return (F.try_mod(a, b), INTEGER) if whole else (F.lit(None).cast("long"), INTEGER)
    if op == "//":
        if not whole:
            return F.floor(ieee_div(a, b)).cast("double"), FLOAT
        return _floordiv(a, b), INTEGER
    if op == "**":
        return F.pow(a.cast("double"), b.cast("double")), FLOAT
    raise ValueError(op)


def _floordiv(a: Column, b: Column) -> Column:
    """Exact floor of the quotient: the truncated one, less one where signs differ and something is left."""
    rest = F.try_mod(a, b)
    exact = F.call_function("div", a - rest, F.nullif(b, F.lit(0).cast("long")))
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), exact - 1).otherwise(exact)


def float_text(c: Column) -> Column:
    """Floats as text: whole ones without a point, never in scientific form."""
    plain = F.regexp_replace(F.format_string("%.17f", c), "0+$", "")
    short = c.cast("string")
    text = F.when(short.contains("E"), F.regexp_replace(plain, r"\.$", "")).otherwise(F.regexp_replace(short, r"\.0$", ""))
    return F.when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf")).otherwise(text)


def parsed(c: Column, to: str) -> Column:
    """Text as a vector, list or map by the parser of delimited text, in Arrow batches: [1;2] and {a: 1} are no JSON."""
    made = dict if to == DICT else lambda x: x
    return F.udf(lambda x: None if x is None or (found := parse(x, to)) is None else made(found), SPARK[to], useArrow=True)(c)


def cast(c: Column, kind: str, to: str) -> Column:
    """c of one type as another; what does not fit is missing, floats saturate as integers."""
    if kind == to:
        return c
    if to == STRING:
        if kind == FLOAT:
            return float_text(c)
        return F.to_json(c) if kind in (VECTOR, LIST, DICT) else c.cast("string")
    if to == INTEGER:
        if kind == FLOAT:
            inside = F.when((c < float(LONG_MAX)) & (c >= float(LONG_MIN)), c)
            return F.when(F.isnan(c), F.lit(0).cast("long")).when(c >= float(LONG_MAX), F.lit(LONG_MAX)).when(c < float(LONG_MIN), F.lit(LONG_MIN)).otherwise(inside.cast("long"))
        if kind == STRING:
            strict = F.when(~c.rlike(r"^\s|\s$"), c)
            return F.coalesce(strict.try_cast("long"), cast(strict.try_cast("double"), FLOAT, INTEGER))
        if kind == DATETIME:
            return F.unix_seconds(c)
    if to == FLOAT:
        if kind == DATETIME:
            return F.unix_micros(c) / 1e6
        return F.when(~c.rlike(r"^\s|\s$"), c).try_cast("double") if kind == STRING else c.cast("double")
    if to == DATETIME and kind in (INTEGER, FLOAT):
        return F.timestamp_seconds(c)
    if to == VECTOR and kind == LIST:
        return F.transform(c, lambda x: x.try_cast("double"))
    if to in (VECTOR, LIST, DICT) and kind == STRING:
        return parsed(c, to)
    if to == LIST and kind == VECTOR:
        return c.cast("array<string>")
    if to == DATETIME and kind == STRING:
        return c.try_cast("timestamp")
    return F.lit(None)


def clip(c: Column, low: object = None, high: object = None) -> Column:
    """c between the bounds; missing stays missing."""
    out = c
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    return out
