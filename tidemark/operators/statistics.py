"""Whole-frame statistics, each in one aggregate over all columns."""

from __future__ import annotations

from functools import reduce as reduce_
from itertools import combinations_with_replacement

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..types import is_numeric

#: The rank of an approximate quantile is off by this part of the rows at most.
ACCURACY = 10_000
STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def numeric(frame) -> list[str]:
    return [c for c in frame.columns if is_numeric(frame.schema[c].dataType)]


def quantiles(frame, columns: list[str], at: list[float], *others):
    """One row: the exact quantiles ``q<column number>_<place in at>`` (linear
    between neighbours, as ``percentile`` gives them), and the aggregates
    ``others``. An aggregate of all values would put the distinct ones of every
    task into one, so approximate quantiles bracket each (their rank is off by a
    10,000th of the rows at most), a count makes sure of the bracket, and only the
    values inside are counted and ranked. The first two passes run here."""
    spark, sdf = frame.sdf.sparkSession, frame._data()
    value = [F.col(f"`{c}`").cast("double") for c in columns]
    wide = [min(1.0, max(0.0, q + s * 2 / ACCURACY)) for q in at for s in (-1, 1)]
    rough = sdf.agg(*[x for v in value for x in (F.count(v), F.min(v), F.max(v), F.percentile_approx(v, wide, ACCURACY))]).first()
    cells = []  # name, column, the bracket's ends, rank of the lower neighbour, share of the upper, least and most
    for i in range(len(columns)):
        n, least, most, ends = rough[4 * i : 4 * i + 4]
        for j, q in enumerate(at):
            if n:
                rank = q * (n - 1)
                cells.append([f"q{i}_{j}", i, ends[2 * j], ends[2 * j + 1], int(rank // 1), rank - rank // 1, least, most])
    if cells:
        inside = [x for _, i, lo, hi, *_ in cells for x in (F.count_if(value[i] < lo), F.count_if(value[i] <= hi))]
        seen = sdf.agg(*inside).first()
        below = list(seen[::2])
        for k, (_, _, _, _, rank, share, least, most) in enumerate(cells):
            if not below[k] <= rank <= rank + (share > 0) < seen[2 * k + 1]:
                cells[k][2:4], below[k] = (least, most), 0  # all values, should the bracket have missed
        # A row goes to the brackets that hold it; most are in none.
        hit = [(value[i] >= lo) & (value[i] <= hi) for _, i, lo, hi, *_ in cells]
        rows = sdf.where(reduce_(lambda a, b: a | b, hit)).select(F.explode(F.array(*[F.struct(F.when(h, F.lit(k)).alias("k"), value[c[1]].alias("v")) for k, (h, c) in enumerate(zip(hit, cells, strict=True))])).alias("x"))
        counted = rows.where("x.k IS NOT NULL").groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = counted.select("k", "v", (before - F.col("n")).alias("from"), before.alias("to"))
        pick = []
        for k, (name, _, _, _, rank, share, *_) in enumerate(cells):
            r = rank - below[k]
            lower, upper = (F.max(F.when((F.col("k") == k) & (F.col("from") <= p) & (F.col("to") > p), F.col("v"))) for p in (r, r + (share > 0)))
            pick.append(F.when(lower == upper, lower).otherwise((1 - share) * lower + share * upper).alias(name))
        found = ranked.agg(*pick)
    else:
        found = spark.range(1).select()
    known = {c[0] for c in cells}
    found = found.select("*", *[F.lit(None).cast("double").alias(f"q{i}_{j}") for i in range(len(columns)) for j in range(len(at)) if f"q{i}_{j}" not in known])
    return found.crossJoin(F.broadcast(sdf.agg(*others))) if others else found


def describe(frame):
    """A row per statistic, a column per numeric column; quartiles are exact."""
    from ..frame import Frame

    columns = numeric(frame)
    if not columns:
        raise ValueError("no numeric column")
    parts = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        parts += [F.count(v).cast("double").alias(f"c{i}_0"), F.avg(v).alias(f"c{i}_1"), F.stddev_samp(v).alias(f"c{i}_2"), F.min(v).alias(f"c{i}_3"), F.max(v).alias(f"c{i}_7")]
    one = quantiles(frame, columns, [0.25, 0.5, 0.75], *parts)
    for i in range(len(columns)):
        one = one.withColumnsRenamed({f"q{i}_{j}": f"c{i}_{j + 4}" for j in range(3)})
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("statistic"), *[F.col(f"c{i}_{k}").alias(c) for i, c in enumerate(columns)]) for k, s in enumerate(STATISTICS)]))
    return Frame(one.select(rows.alias("r")).select(F.col("r.k").alias("__pos"), F.col("r.statistic").alias("statistic"), *[F.col(f"r.`{c}`").alias(c) for c in columns]), ["__pos"], positioned="__pos")


def reduce(frame, fn: str) -> dict[str, float | None]:
    """column -> value, of the numeric columns."""
    from .grouping import aggregate

    columns = numeric(frame)
    if not columns:
        return {}
    if fn == "median":
        row = quantiles(frame, columns, [0.5]).select(*[f"q{i}_0" for i in range(len(columns))]).first()
    else:
        row = frame._data().agg(*[aggregate(fn, F.col(f"`{c}`"), frame.schema[c].dataType) for c in columns]).first()
    return dict(zip(columns, row, strict=True))


def matrix(frame, kind: str):
    """Pairwise statistics (``corr`` or ``cov``) over rows where both are known;
    undefined cells are null. One aggregate; labels are the column names."""
    from ..frame import Frame

    columns = numeric(frame)
    if not columns:
        raise ValueError("no numeric column")
    parts, cell = [], {}
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        a, b = (F.col(f"`{columns[k]}`").cast("double") for k in (i, j))
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        if kind == "cov":
            value = F.covar_samp(a, b)
        else:
            spread = F.stddev_samp(a) * F.stddev_samp(b)
            value = F.covar_samp(a, b) / F.when(spread > 0, spread)
        cell[i, j] = cell[j, i] = f"m_{i}_{j}"
        parts.append(value.alias(cell[i, j]))
    one = frame._data().agg(*parts)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("label"), *[F.col(cell[i, j]).alias(d) for j, d in enumerate(columns)]) for i, c in enumerate(columns)]))
    out = one.select(rows.alias("r")).select(F.col("r.k").cast("bigint").alias("__pos"), F.col("r.label").alias("__index"), *[F.col(f"r.`{c}`").alias(c) for c in columns])
    return Frame(out, ["__pos"], labels=True, positioned="__pos")
