"""The type lattice of the engine on Spark types."""

from __future__ import annotations

import datetime

from pyspark.sql import types as T

DOUBLE, LONG, STRING, BOOL = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()

#: Names of types that users may write.
ALIASES = {
    "float": DOUBLE, "float64": DOUBLE, "float32": DOUBLE, "double": DOUBLE,
    "int": LONG, "int64": LONG, "int32": LONG, "long": LONG, "bigint": LONG,
    "string": STRING, "str": STRING, "bool": BOOL, "boolean": BOOL,
    float: DOUBLE, int: LONG, str: STRING, bool: BOOL,
}


def resolve(kind) -> T.DataType:
    """A Spark type from an alias, a Python type or a Spark type."""
    if isinstance(kind, T.DataType):
        return kind
    found = ALIASES.get(kind.lower() if isinstance(kind, str) else kind)
    if found is None:
        raise TypeError(f"unknown type {kind!r}")
    return found


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def family(t: T.DataType) -> str:
    """number, string, bool, time or other: what values can be compared with."""
    for name, kinds in (("number", T.NumericType), ("string", T.StringType), ("bool", T.BooleanType), ("time", (T.TimestampType, T.TimestampNTZType, T.DateType))):
        if isinstance(t, kinds):
            return name
    return "other"


def dtype_name(t: T.DataType) -> str:
    return {"number": "int64" if is_integral(t) else "float64", "string": "string", "bool": "bool", "time": "datetime"}.get(family(t), t.simpleString())


def common(types: list[T.DataType]) -> T.DataType:
    """The type that holds values of all: numbers widen to long or double, any
    other clash becomes a string."""
    if all(t == types[0] for t in types):
        return types[0]
    if all(is_numeric(t) for t in types):
        return LONG if all(is_integral(t) for t in types) else DOUBLE
    return types[0] if {family(t) for t in types} == {"string"} else STRING


#: A value of each kind that ``infer`` tells apart, by name.
KINDS = {"bool": True, "int": 0, "float": 0.0, "datetime": datetime.datetime(1970, 1, 1), "list": [], "str": ""}


def kind_name(v) -> str | None:
    """The name in KINDS of a value's kind; None of no value."""
    if v is None:
        return None
    return next((k for k in ("bool", "int", "float", "datetime") if isinstance(v, type(KINDS[k]))), "list" if isinstance(v, (list, tuple)) else "str")


def infer(values) -> T.DataType:
    """Type of Python values: whole and fractional numbers make double, any
    other mixture and nothing at all make string."""
    kinds = {bool if isinstance(v, bool) else int if isinstance(v, int) else float if isinstance(v, float) else datetime.datetime if isinstance(v, datetime.datetime) else list if isinstance(v, (list, tuple)) else str for v in values if v is not None}
    if kinds == {int, float} or kinds == {float}:
        return DOUBLE
    return {frozenset({int}): LONG, frozenset({bool}): BOOL, frozenset({datetime.datetime}): T.TimestampNTZType(), frozenset({list}): T.ArrayType(STRING)}.get(frozenset(kinds), STRING)


def check(value, t: T.DataType, column: str):
    """``value`` as stored in a column of type ``t``; a value of another kind is an error."""
    if value is None:
        return None
    fits = {"number": isinstance(value, int) and not isinstance(value, bool) if is_integral(t) else isinstance(value, float), "string": isinstance(value, str), "bool": isinstance(value, bool)}
    if not fits.get(family(t), True):
        raise TypeError(f"column {column!r}: {value!r} is no {dtype_name(t)}")
    return value
