"""Expressions with the engine's null, NaN and cast rules (ANSI mode stays on)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import BOOL, DOUBLE, LONG, STRING, family, is_integral


def divide(a: Column, b: Column) -> Column:
    """True division: x/0 is an infinity of x's sign, 0/0 and NaN/0 are NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def to_double(c: Column, t: T.DataType) -> Column:
    return F.trim(c).cast("double") if family(t) == "string" else c.cast("int").cast("double") if family(t) == "bool" else c.cast("double")


def to_long(c: Column, t: T.DataType) -> Column:
    """Whole part; strings that are no integer are read as a number and cut."""
    if family(t) == "string":
        s = F.trim(c)
        return F.coalesce(s.try_cast("bigint"), F.when(s.try_cast("bigint").isNull(), s.cast("double")).cast("bigint"))
    return c.cast("int").cast("bigint") if family(t) == "bool" else c.cast("bigint")


def cast_to(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Conversion that keeps nulls and raises on a value that doesn't convert."""
    if target == DOUBLE:
        return to_double(c, source)
    if target == LONG:
        return to_long(c, source)
    if target == BOOL:
        return c != 0 if family(source) == "number" else F.trim(c).cast("boolean") if family(source) == "string" else c.cast("boolean")
    return c.cast(target)


def parse_prefix(c: Column, target: T.DataType) -> Column:
    """Lenient typing of text: the leading number, if any; known truth words;
    empty or unreadable text is null."""
    if target == LONG:
        return F.nullif(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")
    if target == DOUBLE:
        return F.nullif(F.regexp_extract(c, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")
    if target == BOOL:
        return F.when(c.isin("true", "True", "TRUE", "1"), True).when(c.isin("false", "False", "FALSE", "0"), False)
    return F.nullif(c, F.lit("")) if target == STRING else c.try_cast(target)


def scalar(value, column_type: T.DataType):
    """A literal next to a column: whole floats stay whole beside integers."""
    if is_integral(column_type) and isinstance(value, float) and value.is_integer():
        return F.lit(int(value))
    return F.lit(value)
