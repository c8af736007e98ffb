"""Grouped aggregation: one hash aggregate with map-side combine for any number
of columns and functions. A null key is a group of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import is_numeric

FUNCTIONS = ("sum", "mean", "count", "min", "max", "std", "median", "first", "last")


def aggregate(fn: str, c: Column, t: T.DataType, order: Column | None = None) -> Column:
    """An aggregate with the engine's rules: sums of nothing are 0, all else of
    nothing is null; first and last are by row order and skip nulls."""
    if fn == "count":
        return F.count(c)
    if fn in ("first", "last"):
        if order is None:
            raise ValueError(f"{fn} needs a row order")
        return (F.min_by if fn == "first" else F.max_by)(c, F.when(c.isNotNull(), order))
    if fn not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {fn!r}")
    if not is_numeric(t):
        return F.lit(0.0) if fn == "sum" else F.max(F.lit(None).cast("double"))
    v = c.cast("double")
    if fn == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0))
    return {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": F.median}[fn](v)


class GroupBy:
    """Rows of a frame by key columns."""

    def __init__(self, frame, by: list[str]):
        self._frame, self._by = frame, by

    def _every(self, fn: str):
        from ..frame import Frame

        rest = [c for c in self._frame.columns if c not in self._by]
        kinds = self._frame.schema
        none = F.lit(None).cast("double")
        exprs = [(aggregate(fn, F.col(f"`{c}`"), kinds[c].dataType) if is_numeric(kinds[c].dataType) else F.max(none)).alias(c) for c in rest]
        grouped = self._frame.sdf.groupBy(*[F.col(f"`{k}`") for k in self._by])
        out = grouped.agg(*exprs) if exprs else self._frame.sdf.select(*self._by).distinct()
        return Frame.from_table(out, order_by=self._by)

    def mean(self):
        return self._every("mean")

    def sum(self):
        return self._every("sum")

    def min(self):
        return self._every("min")

    def max(self):
        return self._every("max")

    def agg(self, spec: dict[str, list[str] | str]):
        """``spec``: column -> functions; the result has <column>_<function>, in
        frame order, then function order."""
        from ..frame import Frame

        spec = {c: [f] if isinstance(f, str) else list(f) for c, f in spec.items()}
        if not spec or not any(spec.values()):
            raise ValueError("nothing to aggregate")
        self._frame._need(*spec)
        order = self._frame._order_struct() if any(f in ("first", "last") for fs in spec.values() for f in fs) else None
        exprs = [aggregate(f, F.col(f"`{c}`"), self._frame.schema[c].dataType, order).alias(f"{c}_{f}") for c in self._frame.columns if c in spec for f in spec[c]]
        return Frame.from_table(self._frame.sdf.groupBy(*[F.col(f"`{k}`") for k in self._by]).agg(*exprs), order_by=self._by)

    def apply(self, fn: Callable, schema: str | T.StructType):
        """``fn`` maps each group's rows, in row order, as a pandas frame to a
        pandas frame of ``schema`` (or None for no rows). Groups go by their keys,
        their rows as ``fn`` gave them. A group is one task's work."""
        from ..frame import Frame

        keys, columns, by = self._frame.order, self._frame.columns, self._by
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        place = [T.StructField(f"__ga{i}", self._frame.schema[k].dataType) for i, k in enumerate(by)] + [T.StructField("__gn", T.LongType())]

        def run(rows):
            import pandas as pd

            out = fn((rows.sort_values(keys, kind="stable") if keys else rows)[columns].reset_index(drop=True))
            if out is None:
                return pd.DataFrame(columns=[*kind.names, *[f.name for f in place]])
            out = out[kind.names].reset_index(drop=True)
            for i, k in enumerate(by):
                value = rows[k].iloc[0]
                out[f"__ga{i}"] = pd.Series([None if pd.isna(value) else value] * len(out), dtype=object)
            return out.assign(__gn=range(len(out)))

        out = self._frame.sdf.groupBy(*by).applyInPandas(run, T.StructType([*kind.fields, *place]))
        return Frame(out, [f.name for f in place])

    def head(self, n: int = 1):
        """First ``n`` rows of each group by row order."""
        from pyspark.sql import Window

        w = Window.partitionBy(*self._by).orderBy(*self._frame._order_columns())
        return self._frame._with(self._frame.sdf.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n"))
