"""Row order on an unordered engine.

A frame's rows are ordered by key columns. Up to ``BUCKET_ROWS`` rows, an ordered
operation is a plain window. Beyond that one window would be one task, so rows
are ranged by splitters (quantiles of a key sample, as literals, so every plan
that uses them ranges alike): windows run inside a bucket, and what a bucket
needs of those before it comes from one row per bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket; buckets and sampled keys per bucket at most.
BUCKET_ROWS, MAX_BUCKETS, SAMPLE = 1_000_000, 4096, 32
#: Splitters that are searched by generated code.
CASES = 64
POS, BUCKET, PLACE = "__pos", "__bucket", "__place"


def ascending(c: Column, kind: T.DataType, up: bool = True, last: bool = True) -> list[Column]:
    """Keys whose ascending order is that of ``c``, up or down, with its nulls last
    or first: the first tells nulls, so that structs of them compare alike."""
    null = c.isNull() if last else c.isNotNull()
    if up:
        return [null, c]
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        nan = F.isnan(c)  # the greatest, and so is its negative
        return [null, ~nan, F.when(~nan, -c)]
    if isinstance(kind, T.IntegralType):
        return [null, F.bitwise_not(c)]  # the negative of the least would overflow
    if isinstance(kind, T.BooleanType):
        return [null, ~c]
    if isinstance(kind, (T.DecimalType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return [null, -c]
    if isinstance(kind, T.DateType):
        return [null, -F.unix_date(c)]
    if isinstance(kind, T.TimestampType):
        return [null, -F.unix_micros(c)]
    if isinstance(kind, T.TimestampNTZType):
        return [null, F.lit("1970-01-01").cast(kind) - c]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # The bytes' digits turned round; the end is above any, so a prefix comes after.
        return [null, F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]
    raise TypeError(f"no descending order of {kind.simpleString()}")


def splitters(df: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> list[tuple]:
    """Keys at about every ``bucket_rows`` rows; none if one bucket is enough."""
    n = df.count()
    buckets = min(MAX_BUCKETS, -(-n // bucket_rows))
    if buckets <= 1:
        return []
    wanted = SAMPLE * buckets
    u = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = df.select(*keys).where(u < min(1.0, wanted / n)).limit(4 * wanted).orderBy(*[F.col(k).asc_nulls_last() for k in keys]).collect()
    cuts = [tuple(sample[len(sample) * j // buckets]) for j in range(1, buckets)] if sample else []
    return list(dict.fromkeys(cuts))


def bucketed(df: DataFrame, keys: list[str], cuts: list[tuple]) -> DataFrame:
    """``df`` with BUCKET, the number of splitters at or before the row's keys
    (nulls last, as in ``splitters``), by binary search: nested cases for a few
    splitters, a projection a step for many, as plans and generated code have
    their limits."""
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    kinds = [df.schema[k].dataType for k in keys]
    if len(cuts) > CASES:
        return _searched(df, keys, kinds, cuts)

    def at_or_after(cut: tuple) -> Column:
        out = F.lit(True)
        for k, v, kind in reversed(list(zip(keys, cut, kinds, strict=True))):
            c = F.col(k)
            if v is None:
                out = c.isNull() & out
            else:
                out = c.isNull() | (c > F.lit(v).cast(kind)) | ((c == F.lit(v).cast(kind)) & out)
        return F.coalesce(out, F.lit(False))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at_or_after(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return df.withColumn(BUCKET, search(0, len(cuts)))


def _searched(df: DataFrame, keys: list[str], kinds: list, cuts: list[tuple]) -> DataFrame:
    # A key is (is null, value), so that structs compare with nulls last.
    out = df.withColumns({PLACE: F.struct(*[x.alias(f"{n}{i}") for i, k in enumerate(keys) for n, x in (("n", F.col(k).isNull()), ("v", F.col(k)))]), BUCKET: F.lit(0)})
    for level in reversed(range(len(cuts).bit_length())):
        # The bucket is a multiple of twice the step, so a step has its own short table.
        step, at = 1 << level, F.col(BUCKET)
        mine = F.get(_table(cuts[step - 1 :: 2 * step], kinds), F.shiftright(at, level + 1))
        out = out.withColumn(BUCKET, F.when(F.col(PLACE) >= mine, at + step).otherwise(at))
    # Each step reads the one before three times; a generator keeps the optimizer from
    # putting one into the other, as it does to follow a join key to its source.
    return out.select(*df.columns, F.stack(F.lit(1), F.col(BUCKET)).alias(BUCKET))


def _table(cuts: list[tuple], kinds: list) -> Column:
    """The splitters as an array of (is null, value) structs: one JSON literal,
    as a tree of a node a value takes longer to plan than to run; its texts are
    cast, which is exact. Other kinds of values are literals one by one."""
    if not all(isinstance(k, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)) for k in kinds):
        return F.array(*[F.struct(*[x.alias(f"{n}{i}") for i, (v, kind) in enumerate(zip(cut, kinds, strict=True)) for n, x in (("n", F.lit(v is None)), ("v", F.lit(v).cast(kind)))]) for cut in cuts])
    text = lambda v: v if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    rows = json.dumps([{f"{n}{i}": x for i, v in enumerate(cut) for n, x in (("n", v is None), ("v", text(v)))} for cut in cuts])
    shape = lambda kind_of: T.ArrayType(T.StructType([f for i, k in enumerate(kinds) for f in (T.StructField(f"n{i}", T.BooleanType()), T.StructField(f"v{i}", kind_of(k)))]))
    return F.from_json(F.lit(rows), shape(lambda _: T.StringType())).cast(shape(lambda k: k))


def _order(keys: list[str], backwards: bool = False):
    return [F.col(k).desc_nulls_first() if backwards else F.col(k).asc_nulls_last() for k in keys]


def with_position(df: DataFrame, keys: list[str], name: str = POS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with its contiguous position, from 0."""
    cuts = splitters(df, keys, bucket_rows)
    if not cuts:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*_order(keys))) - 1).cast("bigint"))
    parted = bucketed(df, keys, cuts)
    # One row per bucket: at most MAX_BUCKETS + 1 in all, so this broadcast is bounded.
    sizes = parted.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(BUCKET, (F.sum("n").over(Window.orderBy(BUCKET)) - F.col("n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*_order(keys))) - 1
    return parted.withColumn(name, rank).join(F.broadcast(before), BUCKET).withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop(BUCKET, "__before")


_OVER = {"sum": F.sum, "max": F.max, "min": F.min, "prod": F.product, "last": lambda c: F.last(c, ignorenulls=True)}


def _carry(kind: str, before: Column, own: Column) -> Column:
    """A running value with that of all buckets before it."""
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(before, own)
    if kind == "last":
        return F.coalesce(own, before)
    return F.coalesce(before + own if kind == "sum" else before * own, own, before)


def running(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, str]], backwards: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with running values from the first row (``backwards``: from the
    last) up to each. ``specs``: output -> (sum, max, min, prod or last, column);
    nulls are skipped, last is the last value that isn't null."""
    cuts = splitters(df, keys, bucket_rows)
    frame = (Window.unboundedPreceding, Window.currentRow)
    if not cuts:
        w = Window.orderBy(*_order(keys, backwards)).rowsBetween(*frame)
        return df.select("*", *[_OVER[kind](F.col(c)).over(w).alias(out) for out, (kind, c) in specs.items()])
    parted = bucketed(df, keys, cuts)
    pick = F.min_by if backwards else F.max_by
    place = F.struct(*keys)
    whole = parted.groupBy(BUCKET).agg(*[
        (pick(F.col(c), F.when(F.col(c).isNotNull(), place)) if kind == "last" else _OVER[kind](F.col(c))).alias(f"__b_{out}") for out, (kind, c) in specs.items()
    ])
    # One row per bucket: at most MAX_BUCKETS + 1 in all, so this broadcast is bounded.
    ahead = Window.orderBy(F.col(BUCKET).desc() if backwards else F.col(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(BUCKET, *[_OVER[kind](F.col(f"__b_{out}")).over(ahead).alias(f"__b_{out}") for out, (kind, _) in specs.items()])
    w = Window.partitionBy(BUCKET).orderBy(*_order(keys, backwards)).rowsBetween(*frame)
    inside = parted.select("*", *[_OVER[kind](F.col(c)).over(w).alias(f"__o_{out}") for out, (kind, c) in specs.items()])
    return inside.join(F.broadcast(before), BUCKET).select(*df.columns, *[_carry(kind, F.col(f"__b_{out}"), F.col(f"__o_{out}")).alias(out) for out, (kind, _) in specs.items()])


def with_halo(df: DataFrame, pos: str, before: int, after: int, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Column]:
    """Rows bucketed by position, with copies of the ``before`` rows ahead of and
    the ``after`` rows behind each bucket, flagged ``__halo``. (rows, bucket)"""
    size = max(bucket_rows, before, after, 1)
    own = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    at = F.pmod(F.col(pos), F.lit(size))
    copies = F.filter(F.array(
        F.struct(own.alias("b"), F.lit(False).alias("halo")),
        F.when(at >= size - before, F.struct((own + 1).alias("b"), F.lit(True).alias("halo"))),
        F.when(at < after, F.struct((own - 1).alias("b"), F.lit(True).alias("halo"))),
    ), lambda x: x.isNotNull())
    return df.withColumn("__copy", F.explode(copies)).withColumns({BUCKET: F.col("__copy.b"), "__halo": F.col("__copy.halo")}).drop("__copy"), F.col(BUCKET)
