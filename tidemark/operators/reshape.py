"""Pivot, melt, stack and unstack."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..types import common, is_numeric
from .grouping import aggregate

PIVOT_FUNCTIONS = ("sum", "mean", "count", "min", "max")
#: New columns that a pivot may make; a column with more values is an error.
MAX_LEVELS = 10_000


def _levels(values) -> list[str]:
    """The distinct strings of a one-column DataFrame, if there aren't too many."""
    found = [r[0] for r in values.distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"over {MAX_LEVELS} new columns")
    return found


def pivot_table(frame, index: list[str], columns: str, values: list[str], agg: str = "mean", fill: float | None = None, levels: list | None = None):
    """Index rows by the values of ``columns``. New columns are in text order,
    <level> for one value column, else <value>_<level>. A cell without values is
    null, or ``fill``. Rows with a null level count for the index only. ``levels``
    saves the job that finds them."""
    from ..frame import Frame

    if agg not in PIVOT_FUNCTIONS:
        raise ValueError(f"agg must be one of {PIVOT_FUNCTIONS}")
    if not index or not values:
        raise ValueError("index and values are needed")
    frame._need(*index, columns, *values)
    level = F.col(f"`{columns}`").cast("string")
    if levels is None:
        levels = _levels(frame._data().where(F.col(f"`{columns}`").isNotNull()).select(level.alias("l")))
    levels = sorted(str(x) for x in levels)
    cells = []
    for v in values:
        kind = frame.schema[v].dataType
        for x in levels:
            own = F.when(level == x, F.col(f"`{v}`"))
            n = F.count(own)
            cell = aggregate(agg, own, kind) if agg != "count" else n.cast("double")
            cell = F.when((n > 0) & F.lit(is_numeric(kind) or agg == "count"), cell)
            cells.append((cell if fill is None else F.coalesce(cell, F.lit(float(fill)))).alias(x if len(values) == 1 else f"{v}_{x}"))
    # Conditional aggregates: one pass and one shuffle of partial sums, as pivot() would plan it.
    out = frame._data().groupBy(*[F.col(f"`{k}`").cast("string").alias(k) for k in index]).agg(*cells) if cells else frame._data().select(*[F.col(f"`{k}`").cast("string").alias(k) for k in index]).distinct()
    return Frame.from_table(out, order_by=index)


def melt(frame, id_vars: list[str], value_vars: list[str] | None = None, var_name: str = "variable", value_name: str = "value"):
    """Wide to long, row by row; nulls are kept. Clashing types become strings."""
    from ..frame import Frame

    value_vars = [c for c in frame.columns if c not in id_vars] if value_vars is None else list(value_vars)
    if not value_vars:
        raise ValueError("nothing to melt")
    frame._need(*id_vars, *value_vars)
    kind = common([frame.schema[c].dataType for c in value_vars])
    cells = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(c).alias("variable"), F.col(f"`{c}`").cast(kind).alias("value")) for i, c in enumerate(value_vars)])
    order = [f"__o{i}" for i in range(len(frame.order))]
    out = frame.sdf.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(frame.order, order, strict=True)], *[F.col(f"`{c}`") for c in id_vars], F.explode(cells).alias("__m"))
    out = out.select(*order, F.col("__m.n").alias("__o"), *[F.col(f"`{c}`") for c in id_vars], F.col("__m.variable").alias(var_name), F.col("__m.value").alias(value_name))
    return Frame(out, [*order, "__o"] if order else [])


def stack(frame):
    """(index, variable, value) of every cell that isn't null."""
    labelled = frame.with_labels()
    from ..frame import Frame

    kind = common([frame.schema[c].dataType for c in frame.columns])
    cells = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(c).alias("variable"), F.col(f"`{c}`").cast(kind).alias("value")) for i, c in enumerate(frame.columns)])
    order = [f"__o{i}" for i in range(len(labelled.order))]
    out = labelled.sdf.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(labelled.order, order, strict=True)], F.col("__index").alias("index"), F.explode(cells).alias("__m"))
    out = out.where(F.col("__m.value").isNotNull()).select(*order, F.col("__m.n").alias("__o"), "index", F.col("__m.variable").alias("variable"), F.col("__m.value").alias("value"))
    return Frame(out, [*order, "__o"])


def unstack(frame, variables: list[str] | None = None):
    """The inverse of ``stack``: a row per index in the order of first
    appearance, a column per variable in text order; the last duplicate wins."""
    from ..frame import Frame

    frame._need("index", "variable", "value")
    place = frame._order_struct()
    if variables is None:
        variables = _levels(frame._data().where("variable IS NOT NULL").select("variable"))
    cells = [F.max_by("value", F.when(F.col("variable") == v, place)).alias(v) for v in sorted(variables)]
    out = frame.sdf.groupBy(F.col("index").alias("__index")).agg(F.min(place).alias("__first"), *cells)
    return Frame(out, ["__first"], labels=True)
