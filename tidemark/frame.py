"""``Frame``: an immutable, labelled view of a Spark DataFrame.

Every method returns a new frame and only extends the logical plan. What needs
row order uses the frame's order keys (columns whose values are unique, or a
hidden ``__pos``); row labels are an ordinary string column ``__index`` that
exists only where labels were set, and are the positions otherwise. Columns whose
names begin with two underscores are the engine's own and hidden.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import exprs
from .functions.accessors import DtAccessor, StrAccessor, parse_datetime
from .operators import grouping, joins, reshape, statistics
from .operators.concat import concat
from .plans import order as plans
from .types import KINDS, check, common, dtype_name, family, infer, is_integral, is_numeric, kind_name, resolve

POS, INDEX = plans.POS, "__index"
#: How the order keys that a sort makes begin.
SORT = "__sort"
OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


class Frame:
    def __init__(self, sdf: DataFrame, order: list[str] | None = None, labels: bool = False, positioned: str | None = None, origin: tuple[Frame, list[str]] | None = None, parts: str | None = None):
        self.sdf, self.order, self._labels = sdf, list(order or []), labels
        #: A column that holds contiguous positions from 0, if one is known.
        self._positioned = positioned
        #: Where rows were dropped or moved: the frame whose labels they bear, and
        #: the columns here that hold its order keys. Labels are joined on demand.
        self._origin = None if labels else origin
        #: A column by whose values default labels start anew.
        self._parts = parts

    # ---------------------------------------------------------------- making

    @classmethod
    def from_table(cls, sdf: DataFrame, order_by: list[str] | str = (), contiguous: bool = False) -> Frame:
        """A frame over a table. ``order_by``: columns that order its rows, unique
        together; ``contiguous``: the only one counts from 0 without a gap."""
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        return cls(sdf, keys, positioned=keys[0] if contiguous and len(keys) == 1 else None)

    @classmethod
    def from_rows(cls, spark: SparkSession, columns: list[str], data: list[list], types: dict) -> Frame:
        """From one list of values per column; every column is typed, and a value
        of another type is an error."""
        if types is None or not columns or not data or len(columns) != len(data):
            raise ValueError("columns, their values and their types are needed")
        if len({len(c) for c in data}) > 1:
            raise ValueError("columns differ in length")
        if missing := [c for c in columns if c not in types]:
            raise ValueError(f"no type for {missing}")
        if len(set(columns)) < len(columns):
            raise ValueError("a column name repeats")
        kinds = [resolve(types[c]) for c in columns]
        rows = [(i, *[check(v, k, c) for v, k, c in zip(row, kinds, columns, strict=True)]) for i, row in enumerate(zip(*data, strict=True))]
        schema = T.StructType([T.StructField(POS, T.LongType()), *[T.StructField(c, k) for c, k in zip(columns, kinds, strict=True)]])
        return cls(spark.createDataFrame(rows, schema), [POS], positioned=POS)

    @classmethod
    def from_columns(cls, spark: SparkSession, columns: dict[str, list], order: list[str] | None = None) -> Frame:
        """From named lists of values; types are inferred."""
        names = list(columns if order is None else order)
        if set(names) != set(columns):
            raise ValueError("order and columns differ")
        kinds = {c: infer(columns[c]) for c in names}
        cast = {T.DoubleType(): float, T.StringType(): str}
        data = [[v if v is None or kinds[c] not in cast else cast[kinds[c]](v) for v in columns[c]] for c in names]
        return cls.from_rows(spark, names, data, kinds) if names and data[0] else cls.empty(spark, names, kinds)

    @classmethod
    def empty(cls, spark: SparkSession, columns: list[str], types: dict | None = None) -> Frame:
        """No rows; columns without a type are strings."""
        fields = [T.StructField(c, resolve((types or {}).get(c, "string"))) for c in columns]
        return cls(spark.createDataFrame([], T.StructType([T.StructField(POS, T.LongType()), *fields])), [POS], positioned=POS)

    # ------------------------------------------------------------- internals

    @property
    def columns(self) -> list[str]:
        return [c for c in self.sdf.columns if not c.startswith("__")]

    @property
    def schema(self) -> T.StructType:
        return self.sdf.select(*[F.col(f"`{c}`") for c in self.columns]).schema

    def _data(self) -> DataFrame:
        return self.sdf.select(*[F.col(f"`{c}`") for c in self.columns])

    def _with(self, sdf: DataFrame, rows_kept: bool = False) -> Frame:
        origin = self._origin or (None if rows_kept or not self.order else (self, self.order))
        return Frame(sdf, self.order, self._labels, self._positioned if rows_kept else None, origin, self._parts)

    def _moved(self, keys: list[str], sdf: DataFrame) -> Frame:
        """``sdf``, made of this frame's rows, in the new order ``keys``; old hidden
        keys stay only as far as labels need them."""
        origin = self._origin or ((self, self.order) if self.order else None)
        if self._labels or origin is None:
            return Frame(sdf.drop(*[k for k in self.order if k.startswith("__")]), keys, self._labels)
        names = [f"__l{i}" for i in range(len(origin[1]))]
        old = {*origin[1], *names, *[k for k in self.order if k.startswith("__")], POS}
        kept = [F.col(f"`{c}`") for c in sdf.columns if c not in old or not c.startswith("__")]
        return Frame(sdf.select(*kept, *[F.col(f"`{k}`").alias(n) for k, n in zip(origin[1], names, strict=True)]), keys, origin=(origin[0], names))

    def _need(self, *columns: str) -> None:
        if missing := [c for c in columns if c not in self.columns]:
            raise KeyError(f"no column {missing}; there are {self.columns}")

    def _order_columns(self) -> list[Column]:
        if not self.order:
            raise ValueError("this needs a row order: Frame.from_table(df, order_by=[...])")
        return [F.col(f"`{k}`").asc_nulls_last() for k in self.order]

    def _order_struct(self) -> Column:
        self._order_columns()
        return F.struct(*[F.col(f"`{k}`") for k in self.order])

    def _project(self, exprs_: list[Column]) -> DataFrame:
        """Hidden columns and order keys stay; data columns are ``exprs_``."""
        return self.sdf.select(*self._hidden(), *exprs_)

    def _hidden(self) -> list[Column]:
        return [F.col(c) for c in self.sdf.columns if c not in self.columns]

    def with_positions(self) -> tuple[Frame, str]:
        """The frame with a contiguous position column, and its name."""
        if self._positioned:
            return self, self._positioned
        self._order_columns()
        keys = [f"__old{i}" for i in range(len(self.order))]
        sdf = self.sdf.select("*", *[F.col(f"`{k}`").alias(o) for k, o in zip(self.order, keys, strict=True)])
        origin = self._origin
        if POS in sdf.columns:
            if origin and POS in origin[1]:  # keeps under another name what labels are joined by
                sdf, origin = sdf.withColumnRenamed(POS, "__l_pos"), (origin[0], ["__l_pos" if k == POS else k for k in origin[1]])
            else:
                sdf = sdf.drop(POS)
        return Frame(plans.with_position(sdf, keys).drop(*keys), [POS], self._labels, POS, origin, self._parts), POS

    def with_labels(self) -> Frame:
        """The frame with its labels as the column __index."""
        if self._labels:
            return self
        if self._origin:
            base, keys = self._origin
            names = [f"__b{i}" for i in range(len(keys))]
            place = base.sdf.select("*", *[F.col(f"`{k}`").alias(n) for k, n in zip(base.order, names, strict=True)])
            named = Frame(place, base.order, base._labels, base._positioned, base._origin, base._parts).with_labels().sdf.select(*names, INDEX)
            on = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
            return Frame(self.sdf.join(named, on).drop(*names), self.order, True)
        f, pos = self.with_positions()
        label = F.col(pos)
        sdf = f.sdf
        if self._parts:
            # One row per part: as many as frames were put together.
            first = sdf.groupBy(F.col(self._parts).alias("__p")).agg(F.min(pos).alias("__first"))
            sdf = sdf.join(F.broadcast(first), F.col(self._parts) == F.col("__p"))
            label = label - F.col("__first")
        return Frame(sdf.withColumn(INDEX, label.cast("string")).drop("__p", "__first"), f.order, True, f._positioned)

    def _own_order(self) -> Frame:
        """Order keys that are data columns survive a projection as hidden ones."""
        shown = [k for k in self.order if not k.startswith("__")]
        if not shown:
            return self
        new = {k: f"__k{i}" for i, k in enumerate(self.order) if k in shown}
        sdf = self.sdf.drop(*new.values()).select("*", *[F.col(f"`{k}`").alias(n) for k, n in new.items()])
        origin = self._origin and (self._origin[0], [new.get(k, k) for k in self._origin[1]])
        return Frame(sdf, [new.get(k, k) for k in self.order], self._labels, new.get(self._positioned, self._positioned), origin, self._parts)

    # ------------------------------------------------- projection, columns

    def select(self, *columns: str) -> Frame:
        if not columns:
            raise ValueError("no columns")
        self._need(*columns)
        f = self._own_order()
        return f._with(f._project([F.col(f"`{c}`") for c in columns]), True)

    def col(self, column: str) -> Column:
        self._need(column)
        return F.col(f"`{column}`")

    select_col = col
    __getitem__ = col

    def rename(self, names: dict[str, str]) -> Frame:
        """All names change at once, so swaps work."""
        if not names:
            raise ValueError("nothing to rename")
        self._need(*names)
        new = [names.get(c, c) for c in self.columns]
        if len(set(new)) < len(new):
            raise ValueError(f"a column name repeats in {new}")
        f = self._own_order()
        return f._with(f._project([F.col(f"`{c}`").alias(n) for c, n in zip(self.columns, new, strict=True)]), True)

    def drop(self, columns: list[str] | None = None, index: list[str] | None = None, labels: list[str] | None = None, axis: int = 0, errors: str = "raise") -> Frame:
        """Columns, or all rows that bear a label. columns go before index, and
        that before labels with an axis."""
        if errors not in ("raise", "ignore"):
            raise ValueError("errors must be raise or ignore")
        if columns is None and index is None:
            if labels is None:
                raise ValueError("nothing to drop")
            columns, index = (labels, None) if axis == 1 else (None, labels)
        if columns is not None:
            if errors == "raise":
                self._need(*columns)
            f = self._own_order()
            return f._with(f._project([F.col(f"`{c}`") for c in self.columns if c not in columns]), True)
        f = self.with_labels()
        if errors == "raise":
            known = {r[0] for r in f.sdf.where(F.col(INDEX).isin(list(index))).select(INDEX).distinct().collect()}
            if missing := [x for x in index if x not in known]:
                raise KeyError(f"no row {missing}")
        return f._with(f.sdf.where(~F.col(INDEX).isin(list(index))))

    def assign(self, name: str, value: Column) -> Frame:
        """A new or replaced column."""
        if name in self.columns:
            f = self._own_order()
            return f._with(f._project([value.alias(c) if c == name else F.col(f"`{c}`") for c in self.columns]), True)
        return self._with(self.sdf.withColumn(name, value), True)

    def assign_func(self, name: str, fn: Callable[[dict], object], returns=None) -> Frame:
        """A column from a function of each row (a dict)."""
        return self.assign(name, self._row_udf(fn, returns))

    def insert(self, loc: int, name: str, value: Column) -> Frame:
        if not 0 <= loc <= len(self.columns):
            raise IndexError(f"position {loc} of {len(self.columns)}")
        if name in self.columns:
            raise ValueError(f"column {name!r} exists")
        cols = [F.col(f"`{c}`") for c in self.columns]
        f = self._own_order()
        return f._with(f._project([*cols[:loc], value.alias(name), *cols[loc:]]), True)

    def pipe(self, fn: Callable[[Frame], Frame]) -> Frame:
        if fn is None:
            raise ValueError("no function")
        return fn(self)

    def copy(self) -> Frame:
        return self

    # ------------------------------------------------------- rows by place

    def head(self, n: int = 5) -> Frame:
        return self._with(self.sdf.orderBy(*self._order_columns()).limit(max(n, 0)), True)

    def tail(self, n: int = 5) -> Frame:
        back = [F.col(f"`{k}`").desc_nulls_first() for k in self.order] if self.order else self._order_columns()
        return self._with(self.sdf.orderBy(*back).limit(max(n, 0)))

    def slice(self, positions: list[int]) -> Frame:
        """Rows at these positions, in this order; repeats allowed."""
        f, pos = self.with_positions()
        n = len(f) if positions and max(positions) >= 0 else 0
        if bad := [p for p in positions if not 0 <= p < n]:
            raise IndexError(f"no row at {bad}")
        return f._gather(pos, [int(p) for p in positions], "long")

    def _gather(self, key: str, wanted: list, kind: str) -> Frame:
        # The list comes from the caller's memory: its broadcast is as large as that.
        asked = self.sdf.sparkSession.createDataFrame([(i, v) for i, v in enumerate(wanted)], f"__ord long, __want {kind}")
        own = self._own_order()
        out = own._moved(["__ord"], own.sdf.drop("__ord").join(F.broadcast(asked), F.col(f"`{key}`") == F.col("__want")).drop("__want"))
        return Frame(out.sdf, out.order, out._labels, "__ord", out._origin)

    def set_index(self, labels: list[str] | str) -> Frame:
        """Labels from a column, or from a list as long as the frame."""
        if isinstance(labels, str):
            self._need(labels)
            return Frame(self.sdf.drop(INDEX).withColumn(INDEX, F.col(f"`{labels}`").cast("string")), self.order, True, self._positioned)
        f, pos = self.with_positions()
        if len(f) != len(labels):
            raise ValueError("labels and rows differ in number")
        given = f.sdf.sparkSession.createDataFrame(list(enumerate(labels)), "__p long, __label string")
        sdf = f.sdf.drop(INDEX).join(given, F.col(f"`{pos}`") == F.col("__p")).drop("__p").withColumnRenamed("__label", INDEX)
        return Frame(sdf, f.order, True, f._positioned)

    def reset_index(self) -> Frame:
        return Frame(self.sdf.drop(INDEX), self.order, False, self._positioned)  # no origin: labels start anew

    def set_multi_index(self, columns: list[str], sep: str = "_") -> Frame:
        """Labels of several columns' values joined; null reads ``null``."""
        if not columns:
            raise ValueError("no columns")
        self._need(*columns)
        label = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns])
        return Frame(self.sdf.drop(INDEX).withColumn(INDEX, label), self.order, True, self._positioned)

    def index(self) -> list[str]:
        f = self.with_labels()
        return [r[0] for r in f.sdf.orderBy(*f._order_columns()).select(INDEX).collect()]

    @property
    def loc(self) -> Loc:
        return Loc(self)

    @property
    def iloc(self) -> ILoc:
        return ILoc(self)

    # --------------------------------------------------------------- filters

    def filter(self, column: str, op: str, value) -> Frame:
        """Rows whose value compares; a null never does, not even by ``!=``."""
        self._need(column)
        if op not in OPS:
            raise ValueError(f"op must be one of {list(OPS)}")
        kind = self.schema[column].dataType
        if family(kind) in ("number", "string", "bool") and family(kind) != family(infer([value])):
            raise TypeError(f"{column!r} is {dtype_name(kind)}, {value!r} isn't")
        return self._with(self.sdf.where(OPS[op](F.col(f"`{column}`"), F.lit(value))))

    def where(self, predicate: str | Column | Callable[[dict], bool]) -> Frame:
        """Rows for which SQL text or a column holds (these reach the scan), or a
        Python function of the row (a dict) is true."""
        if callable(predicate) and not isinstance(predicate, Column):
            predicate = self._row_udf(predicate, "bool")
        return self._with(self.sdf.where(predicate))

    def result(self) -> Frame:
        """Ends a chain of filters; errors were raised where they arose."""
        return self

    must_result = result

    def err(self) -> None:
        return None

    def _row_udf(self, fn: Callable[[dict], object], returns=None) -> Column:
        columns = self.columns
        if returns is None:
            # From all rows: a later value may be of another kind than the first ones.
            kind = F.udf(lambda *values: kind_name(fn(dict(zip(columns, values, strict=True)))), "string", useArrow=True)(*[F.col(f"`{c}`") for c in columns])
            returns = infer([KINDS[r[0]] for r in self._data().select(kind.alias("kind")).distinct().collect() if r[0] is not None])
        kind = resolve(returns)
        fix = {T.DoubleType(): float, T.LongType(): int, T.StringType(): str, T.BooleanType(): bool}.get(kind, lambda v: v)

        def run(*values):
            out = fn(dict(zip(columns, values, strict=True)))
            return None if out is None else fix(out)

        return F.udf(run, kind, useArrow=True)(*[F.col(f"`{c}`") for c in columns])

    # ------------------------------------------------ arithmetic, comparison

    def _operand(self, column: str) -> tuple[Column, T.DataType]:
        self._need(column)
        kind = self.schema[column].dataType
        if not is_numeric(kind):
            raise TypeError(f"column {column!r} isn't numeric")
        return F.col(f"`{column}`"), kind

    def _arith(self, left: str, right, fn) -> Column:
        a, kind = self._operand(left)
        b = self._operand(right)[0] if isinstance(right, str) else exprs.scalar(right, kind)
        return fn(a, b)

    def add(self, left: str, right: str | float) -> Column:
        """Sum of two columns, or of one and a number; null if either is."""
        return self._arith(left, right, lambda a, b: a + b)

    def sub(self, left: str, right: str | float) -> Column:
        return self._arith(left, right, lambda a, b: a - b)

    def mul(self, left: str, right: str | float) -> Column:
        return self._arith(left, right, lambda a, b: a * b)

    def div(self, left: str, right: str | float) -> Column:
        """True division; by zero it gives infinities and NaN."""
        return self._arith(left, right, exprs.divide)

    def pow(self, left: str, right: str | float) -> Column:
        return self._arith(left, right, F.pow)

    add_scalar, sub_scalar, mul_scalar, div_scalar, pow_scalar = add, sub, mul, div, pow

    def _compare(self, left: str, op: str, right: Column, kind: T.DataType) -> Column:
        self._need(left)
        a, own = F.col(f"`{left}`"), self.schema[left].dataType
        same = family(own) == family(kind) and family(own) != "other"
        if op in ("==", "!="):
            if same:
                return OPS[op](a, right)
            return F.when(a.isNotNull() & right.isNotNull(), F.lit(op == "!="))
        if not same or family(own) == "bool":
            raise TypeError(f"{dtype_name(own)} and {dtype_name(kind)} have no order")
        return OPS[op](a, right)

    def compare(self, left: str, op: str, right: str) -> Column:
        """Two columns, as a boolean column; ``==`` of different kinds is false."""
        self._need(right)
        return self._compare(left, op, F.col(f"`{right}`"), self.schema[right].dataType)

    def compare_scalar(self, column: str, op: str, value) -> Column:
        if value is None:
            raise ValueError("no value to compare with")
        return self._compare(column, op, F.lit(value), infer([value]))

    def gt(self, left: str, right: str) -> Column:
        return self.compare(left, ">", right)

    def lt(self, left: str, right: str) -> Column:
        return self.compare(left, "<", right)

    def ge(self, left: str, right: str) -> Column:
        return self.compare(left, ">=", right)

    def le(self, left: str, right: str) -> Column:
        return self.compare(left, "<=", right)

    def eq(self, left: str, right: str) -> Column:
        return self.compare(left, "==", right)

    def ne(self, left: str, right: str) -> Column:
        return self.compare(left, "!=", right)

    def gt_scalar(self, column: str, value) -> Column:
        return self.compare_scalar(column, ">", value)

    def lt_scalar(self, column: str, value) -> Column:
        return self.compare_scalar(column, "<", value)

    def ge_scalar(self, column: str, value) -> Column:
        return self.compare_scalar(column, ">=", value)

    def le_scalar(self, column: str, value) -> Column:
        return self.compare_scalar(column, "<=", value)

    def eq_scalar(self, column: str, value) -> Column:
        return self.compare_scalar(column, "==", value)

    def ne_scalar(self, column: str, value) -> Column:
        return self.compare_scalar(column, "!=", value)

    # ------------------------------------------------------ functions, casts

    def apply(self, column: str, fn: Callable, returns=None) -> Frame:
        """``fn`` of each value. A function that takes and gives a Column stays in
        the JVM; any other runs as an Arrow UDF of type ``returns``, or else of
        what all its values have in common, for which it runs once more."""
        self._need(column)
        try:
            out = fn(F.col(f"`{column}`"))
        except Exception:
            out = None
        if not isinstance(out, Column):
            if returns is None:
                kind = F.udf(lambda v: kind_name(fn(v)), "string", useArrow=True)(F.col(f"`{column}`"))
                returns = infer([KINDS[r[0]] for r in self._data().select(kind.alias("kind")).distinct().collect() if r[0] is not None])
            kind = resolve(returns)
            fix = float if kind == T.DoubleType() else lambda v: v
            out = F.udf(lambda v: None if (x := fn(v)) is None else fix(x), kind, useArrow=True)(F.col(f"`{column}`"))
        return self.assign(column, out)

    def map(self, column: str, mapping: dict) -> Frame:
        """Values replaced by a dict; others, and nulls, stay."""
        self._need(column)
        own = self.schema[column].dataType
        kind = common([own, infer(mapping.values())]) if mapping else own
        out = F.col(f"`{column}`").cast(kind)
        for old, new in reversed(mapping.items()):
            if family(infer([old])) == family(own):
                out = F.when(F.col(f"`{column}`") == F.lit(old), F.lit(new).cast(kind)).otherwise(out)
        return self.assign(column, out)

    def apply_row(self, fn: Callable[[dict], dict], returns: dict) -> Frame:
        """``fn`` maps each row (a dict) to a dict of columns ``returns`` (name ->
        type); columns of the frame stand first, new ones after in text order."""
        names = [c for c in self.columns if c in returns] + sorted(set(returns) - set(self.columns))
        kinds = T.StructType([T.StructField(c, resolve(returns[c])) for c in names])
        columns = self.columns

        def run(*values):
            out = fn(dict(zip(columns, values, strict=True)))
            return tuple(out.get(c) for c in names)

        f = self._own_order()
        row = f.sdf.withColumn("__row", F.udf(run, kinds, useArrow=True)(*[F.col(f"`{c}`") for c in columns]))
        return f._with(row.select(*f._hidden(), *[F.col(f"__row.`{c}`").alias(c) for c in names]), True)

    def astype(self, column: str, kind) -> Frame:
        """Another type; a value that doesn't convert is an error."""
        self._need(column)
        return self.assign(column, exprs.cast_to(F.col(f"`{column}`"), self.schema[column].dataType, resolve(kind)))

    def to_datetime(self, column: str, layout: str = "") -> Frame:
        self._need(column)
        if family(self.schema[column].dataType) == "time":
            return self
        return self.assign(column, parse_datetime(F.col(f"`{column}`"), layout))

    def str(self, column: str) -> StrAccessor:
        self._need(column)
        if family(self.schema[column].dataType) != "string":
            raise TypeError(f"column {column!r} holds no strings")
        return StrAccessor(F.col(f"`{column}`"))

    def dt(self, column: str) -> DtAccessor:
        self._need(column)
        if family(self.schema[column].dataType) != "time":
            raise TypeError(f"column {column!r} holds no date-times")
        return DtAccessor(F.col(f"`{column}`"))

    # ---------------------------------------------------------- missing data

    def fillna(self, value) -> Frame:
        """Nulls of every column that can hold the value; NaN isn't null."""
        if value is None:
            raise ValueError("no value to fill with")
        out = self
        for c in self.columns:
            if family(self.schema[c].dataType) == family(infer([value])):
                out = out.fillna_column(c, value)
        return out

    def fillna_column(self, column: str, value) -> Frame:
        self._need(column)
        kind = self.schema[column].dataType
        if value is None or family(kind) != family(infer([value])):
            raise TypeError(f"{value!r} doesn't fit {dtype_name(kind)} column {column!r}")
        return self.assign(column, F.coalesce(F.col(f"`{column}`"), F.lit(int(value) if is_integral(kind) else value).cast(kind)))

    def fillna_method(self, method: str, bucket_rows: int = plans.BUCKET_ROWS) -> Frame:
        """``ffill`` or ``bfill`` along the rows; the edge stays null."""
        if method not in ("ffill", "bfill"):
            raise ValueError("method must be ffill or bfill")
        self._order_columns()
        f = self._own_order()
        specs = {f"__f_{i}": ("last", c) for i, c in enumerate(self.columns)}
        out = plans.running(f.sdf, f.order, specs, method == "bfill", bucket_rows)
        return f._with(out.select(*f._hidden(), *[F.col(f"__f_{i}").alias(c) for i, c in enumerate(self.columns)]), True)

    def dropna(self, how: str = "any", subset: list[str] | None = None) -> Frame:
        if how not in ("any", "all"):
            raise ValueError("how must be any or all")
        self._need(*(subset or []))
        known = [F.col(f"`{c}`").isNotNull() for c in subset or self.columns]
        keep = known[0]
        for k in known[1:]:
            keep = keep & k if how == "any" else keep | k
        return self._with(self.sdf.where(keep))

    def isna(self) -> Frame:
        f = self._own_order()
        return f._with(f._project([F.col(f"`{c}`").isNull().alias(c) for c in self.columns]), True)

    def notna(self) -> Frame:
        f = self._own_order()
        return f._with(f._project([F.col(f"`{c}`").isNotNull().alias(c) for c in self.columns]), True)

    def null_count(self) -> dict[str, int]:
        row = self._data().agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in self.columns]).first()
        return dict(zip(self.columns, row, strict=True))

    # --------------------------------------------------- joins, aggregation

    def merge(self, other: Frame, on: str, how: str = "inner", suffixes: tuple[str, str] | None = None) -> Frame:
        return joins.merge(self, other, [on], how, suffixes)

    def merge_on(self, other: Frame, on: list[str], how: str = "inner", suffixes: tuple[str, str] | None = None) -> Frame:
        return joins.merge(self, other, list(on), how, suffixes)

    def group_by(self, by: list[str] | str, axis: int = 0) -> grouping.GroupBy:
        by = [by] if isinstance(by, str) else list(by)
        if axis != 0:
            raise ValueError("only axis 0")
        if not by:
            raise ValueError("no key columns")
        self._need(*by)
        return grouping.GroupBy(self, by)

    def describe(self) -> Frame:
        return statistics.describe(self)

    def mean(self) -> dict:
        return statistics.reduce(self, "mean")

    def sum(self) -> dict:
        return statistics.reduce(self, "sum")

    def std(self) -> dict:
        return statistics.reduce(self, "std")

    def median(self) -> dict:
        return statistics.reduce(self, "median")

    def min(self) -> dict:
        return statistics.reduce(self, "min")

    def max(self) -> dict:
        return statistics.reduce(self, "max")

    def corr(self) -> Frame:
        return statistics.matrix(self, "corr")

    def cov(self) -> Frame:
        return statistics.matrix(self, "cov")

    def value_counts(self, column: str) -> Frame:
        """(column, count) of the values that aren't null, most frequent first,
        ties in text order."""
        self._need(column)
        c = F.col(f"`{column}`")
        counts = self._data().where(c.isNotNull()).groupBy(c.alias(column)).agg(F.count(F.lit(1)).alias("count"))
        counts = counts.withColumns({"__c": -F.col("count"), "__t": F.col(f"`{column}`").cast("string")})
        return Frame(counts, ["__c", "__t"])

    def unique(self, column: str) -> Frame:
        """Distinct values in the order of first appearance; one null."""
        self._need(column)
        first = self.sdf.groupBy(F.col(f"`{column}`").alias(column)).agg(F.min(self._order_struct()).alias("__first"))
        return Frame(first, ["__first"])

    def nunique(self, column: str) -> int:
        self._need(column)
        return self._data().agg(F.count_distinct(F.col(f"`{column}`"))).first()[0]

    def sample(self, n: int, seed: int = 0) -> Frame:
        """``n`` rows without repeats, in random order; the same for a seed,
        however the rows are partitioned."""
        if not 0 <= n <= len(self):
            raise ValueError(f"{n} of {len(self)} rows")
        self._order_columns()
        f = self._own_order()
        drawn = f.sdf.withColumn("__draw", F.struct(F.xxhash64(F.lit(seed), *[F.col(k) for k in f.order]), *[F.col(k) for k in f.order]))
        return f._moved(["__draw"], drawn.orderBy("__draw").limit(n))

    # ------------------------------------------------------------ duplicates

    def duplicated(self, subset: list[str] | None = None, keep: str = "first") -> Frame:
        """The column ``duplicated`` for every row; nulls equal each other. An
        aggregate finds the row that is kept of each value, and a join tells the
        others, so a hot value is combined map-side and its rows are split."""
        subset = list(subset or self.columns)
        self._need(*subset)
        if keep not in ("first", "last", "none"):
            raise ValueError("keep must be first, last or none")
        f = self._own_order()
        place = F.struct(F.lit(0)) if keep == "none" else f._order_struct()
        same = {c: f"__g{i}" for i, c in enumerate(subset)}
        kept = (F.max if keep == "last" else F.min)(place).alias("__kept")
        groups = f.sdf.groupBy(*[F.col(f"`{c}`").alias(g) for c, g in same.items()]).agg(kept, F.count(F.lit(1)).alias("__n"))
        on = None
        for c, g in same.items():
            equal = F.col(f"`{c}`").eqNullSafe(F.col(g))
            on = equal if on is None else on & equal
        flag = F.col("__n") > 1 if keep == "none" else ~place.eqNullSafe(F.col("__kept"))
        return f._with(f.sdf.join(groups, on).select(*f._hidden(), flag.alias("duplicated")), True)

    def drop_duplicates(self, subset: list[str] | None = None, keep: str = "first") -> Frame:
        """The first (or last) row by row order of each, or none of those that
        repeat. A hash aggregate finds it: hot values are combined map-side."""
        subset = list(subset or self.columns)
        if keep not in ("first", "last", "none"):
            raise ValueError("keep must be first, last or none")
        self._need(*subset)
        f = self._own_order()
        whole = F.struct(*[F.col(f"`{c}`") for c in f.sdf.columns])
        pick = F.max_by if keep == "last" else F.min_by
        place = F.struct(*[F.col(k) for k in f.order]) if f.order else F.xxhash64(whole)
        kept = f.sdf.groupBy(*[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(subset)]).agg(pick(whole, place).alias("__r"), F.count(F.lit(1)).alias("__n"))
        if keep == "none":
            kept = kept.where("__n = 1")
        return f._with(kept.select("__r.*"))

    # -------------------------------------------------------- ordered window

    def rolling(self, window: int, bucket_rows: int = plans.BUCKET_ROWS) -> Rolling:
        return Rolling(self, window, bucket_rows)

    def shift(self, periods: int, bucket_rows: int = plans.BUCKET_ROWS) -> Frame:
        """Every column moved down (up if negative); labels stay."""
        f, pos = self._own_order().with_positions()
        k = abs(periods)
        rows, bucket = plans.with_halo(f.sdf, pos, k if periods > 0 else 0, k if periods < 0 else 0, bucket_rows)
        w = Window.partitionBy(bucket).orderBy(pos)
        move = (lambda c: F.lag(c, k).over(w)) if periods >= 0 else (lambda c: F.lead(c, k).over(w))
        out = rows.select(*f._hidden(), "__halo", *[move(F.col(f"`{c}`")).alias(c) for c in f.columns])
        return f._with(out.where(~F.col("__halo")).drop("__halo"), True)

    def _running(self, kind: str, bucket_rows: int) -> Frame:
        self._order_columns()
        f = self._own_order()
        cols = statistics.numeric(f)
        doubles = f.sdf.select(*f._hidden(), *[F.col(f"`{c}`").cast("double").alias(c) if c in cols else F.col(f"`{c}`") for c in f.columns])
        out = plans.running(doubles, f.order, {f"__r_{i}": (kind, c) for i, c in enumerate(cols)}, bucket_rows=bucket_rows)
        at = {c: i for i, c in enumerate(cols)}
        return f._with(out.select(*f._hidden(), *[F.when(F.col(f"`{c}`").isNotNull(), F.col(f"__r_{at[c]}")).alias(c) if c in at else F.col(f"`{c}`") for c in f.columns]), True)

    def cumsum(self, bucket_rows: int = plans.BUCKET_ROWS) -> Frame:
        """Running sums of numeric columns; nulls stay and are skipped."""
        return self._running("sum", bucket_rows)

    def cummax(self, bucket_rows: int = plans.BUCKET_ROWS) -> Frame:
        return self._running("max", bucket_rows)

    def cummin(self, bucket_rows: int = plans.BUCKET_ROWS) -> Frame:
        return self._running("min", bucket_rows)

    def cumprod(self, bucket_rows: int = plans.BUCKET_ROWS) -> Frame:
        return self._running("prod", bucket_rows)

    # --------------------------------------------------------------- sorting

    def sort_values(self, by: list[str] | str, ascending: bool | list[bool] = True, na_position: str = "last", ignore_index: bool = False) -> Frame:
        """Stable; nulls stand last (or first) in either direction."""
        by = [by] if isinstance(by, str) else list(by)
        self._need(*by)
        up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending) or [True] * len(by)
        if not by or len(up) not in (1, len(by)):
            raise ValueError("by and ascending don't fit")
        if na_position not in ("first", "last"):
            raise ValueError("na_position must be first or last")
        up = up * len(by) if len(up) == 1 else up
        f = self._own_order()
        last = na_position == "last"
        return f._sorted([k for c, a in zip(by, up, strict=True) for k in plans.ascending(F.col(f"`{c}`"), f.schema[c].dataType, a, last)], not ignore_index)

    def _sorted(self, keys: list[Column], labels: bool) -> Frame:
        """The order becomes these keys, which ascend, and the old order's behind
        them. They are values of the row: numbers of sorted rows would differ from one
        evaluation of a plan to the next. ``to_spark`` sorts by them globally."""
        self._order_columns()
        # Keys of sorts before are still read, by the order or to join labels.
        used = [*self.order, *(self._origin[1] if self._origin else [])]
        tag = next(t for t in (f"{SORT}{i}_" for i in range(3)) if not any(k.startswith(t) for k in used))
        new = {f"{tag}{i}": k for i, k in enumerate([*keys, *[F.col(f"`{k}`") for k in self.order]])}
        moved = self._moved(list(new), self.sdf.drop(*new).select("*", *[k.alias(n) for n, k in new.items()]))
        return moved if labels else Frame(moved.sdf.drop(INDEX), moved.order)

    def sort_index(self, ascending: bool = True) -> Frame:
        f = self._own_order().with_labels()
        return f._sorted(plans.ascending(F.col(INDEX), T.StringType(), ascending, True), True)

    def topk(self, by: list[str], k: int, ascending: bool | list[bool] = False) -> Frame:
        """The first ``k`` rows of a sort: a bounded heap per task, no full sort."""
        by = [by] if isinstance(by, str) else list(by)
        self._need(*by)
        up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
        keys = [F.col(f"`{c}`").asc_nulls_last() if a else F.col(f"`{c}`").desc_nulls_last() for c, a in zip(by, up, strict=True)]
        return self._with(self.sdf.orderBy(*keys, *self._order_columns()).limit(k))

    # --------------------------------------------------------------- reshape

    def pivot_table(self, index: list[str], columns: str, values: list[str], agg: str = "mean", fill: float | None = None, levels: list | None = None) -> Frame:
        return reshape.pivot_table(self, [index] if isinstance(index, str) else list(index), columns, [values] if isinstance(values, str) else list(values), agg, fill, levels)

    def melt(self, id_vars: list[str], value_vars: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return reshape.melt(self, list(id_vars), value_vars, var_name, value_name)

    def stack(self) -> Frame:
        return reshape.stack(self)

    def unstack(self, variables: list[str] | None = None) -> Frame:
        return reshape.unstack(self, variables)

    def concat(self, others: list[Frame], **options) -> Frame:
        return concat([self, *others], **options)

    # ----------------------------------------------------------- categorical

    def as_categorical(self, column: str) -> Frame:
        """The column as text, and <column>_code: its categories numbered by first
        appearance, null -1."""
        cats = self.categories(column).sdf.select(F.col("category").alias("__cat"), F.col("code").alias("__code"))
        text = self.assign(column, F.col(f"`{column}`").cast("string"))
        out = text.sdf.join(cats, F.col(f"`{column}`") == F.col("__cat"), "left")
        return text._with(out.withColumn(f"{column}_code", F.coalesce("__code", F.lit(-1)).cast("int")).drop("__cat", "__code"), True)

    def categories(self, column: str) -> Frame:
        """(category, code), by code."""
        self._need(column)
        first = self.sdf.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("category")).agg(F.min(self._order_struct()).alias("__first"))
        keys = [f"__o{i}" for i in range(len(self.order))]
        first = first.select("category", *[F.col(f"__first.`{k}`").alias(o) for k, o in zip(self.order, keys, strict=True)])
        coded = plans.with_position(first, keys, "code")
        return Frame(coded.select("category", F.col("code").cast("int").alias("code")), ["code"], positioned="code")

    # --------------------------------------------------------------- display

    def __len__(self) -> int:
        return self.sdf.count()

    def dtypes(self) -> dict[str, str]:
        return {f.name: dtype_name(f.dataType) for f in self.schema}

    def info(self) -> str:
        """Rows, columns, and per column its known values and type; one pass."""
        known = self._data().agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in self.columns]).first()
        kinds = self.dtypes()
        lines = [f"{known[0]} rows x {len(self.columns)} columns", *[f"{c}  {n} non-null  {kinds[c]}" for c, n in zip(self.columns, known[1:], strict=True)]]
        return "\n".join(lines)

    def __str__(self) -> str:
        """A text table of the first ten rows."""
        show = lambda v: "null" if v is None else str(v)
        rows = [[show(v) for v in r] for r in self.head(10)._data().collect()] if self.order else [[show(v) for v in r] for r in self._data().take(10)]
        width = [max(len(x) for x in [c, *[r[i] for r in rows]]) for i, c in enumerate(self.columns)]
        line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
        cells = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, width, strict=True)) + "|"
        return "\n".join([line, cells(self.columns), line, *map(cells, rows), line, f"[{len(self)} rows x {len(self.columns)} columns]"])

    def collect(self) -> list[tuple]:
        """All rows in row order, on the driver."""
        sdf = self.sdf.orderBy(*self._order_columns()) if self.order else self.sdf
        return [tuple(r) for r in sdf.select(*[F.col(f"`{c}`") for c in self.columns]).collect()]

    def to_spark(self) -> DataFrame:
        """The data columns as a DataFrame, sorted if the frame's order is a sort's."""
        if not (self.order and self.order[0].startswith(SORT)):
            return self._data()
        return self.sdf.orderBy(*self._order_columns()).select(*[F.col(f"`{c}`") for c in self.columns])

    def series(self, column: str):
        from .series import Series

        return Series(self, column)

    # ----------------------------------------------------------------- sinks

    def to_csv(self, path: str = "", sep: str = ",") -> str | None:
        from .sources import writers

        return writers.to_csv(self, path, sep)

    def to_json(self, path: str = "") -> str | None:
        from .sources import writers

        return writers.to_json(self, path)

    def to_parquet(self, path: str, null_mode: str = "keep") -> None:
        from .sources import writers

        writers.to_parquet(self, path, null_mode)

    def to_excel(self, path: str, sheet: str = "Sheet1") -> None:
        from .sources import writers

        writers.to_excel(self, path, sheet)

    def plot_bar(self, x: str, y: str, **options) -> None:
        from . import plot

        plot.bar(self, x, y, **options)

    def plot_line(self, x: str, ys: list[str], **options) -> None:
        from . import plot

        plot.line(self, x, ys, **options)

    def plot_pie(self, label: str, value: str, **options) -> None:
        from . import plot

        plot.pie(self, label, value, **options)

    def plot_scatter(self, x: str, y: str, **options) -> None:
        from . import plot

        plot.scatter(self, x, y, **options)

    def plot_histogram(self, column: str, bins: int = 10, **options) -> None:
        from . import plot

        plot.histogram(self, column, bins, **options)

    def plot_heatmap(self, **options) -> None:
        from . import plot

        plot.heatmap(self, **options)


class Rolling:
    """Trailing windows of a number of rows. A value is null unless its window
    is full of known values; columns that aren't numeric pass through."""

    def __init__(self, frame: Frame, window: int, bucket_rows: int):
        self._frame, self._n, self._bucket_rows = frame, window, bucket_rows

    def _over(self, fn) -> Frame:
        if self._n < 1:
            raise ValueError("a window has one row at least")
        f, pos = self._frame._own_order().with_positions()
        rows, bucket = plans.with_halo(f.sdf, pos, self._n - 1, 0, self._bucket_rows)
        w = Window.partitionBy(bucket).orderBy(pos).rowsBetween(-(self._n - 1), 0)
        cols = set(statistics.numeric(f))

        def value(c: str) -> Column:
            x = F.col(f"`{c}`").cast("double")
            return F.when(F.count(x).over(w) == self._n, fn(x).over(w)).alias(c) if c in cols else F.col(f"`{c}`")

        out = rows.select(*f._hidden(), "__halo", *[value(c) for c in f.columns])
        return f._with(out.where(~F.col("__halo")).drop("__halo"), True)

    def mean(self) -> Frame:
        return self._over(F.avg)

    def sum(self) -> Frame:
        return self._over(F.sum)

    def min(self) -> Frame:
        return self._over(F.min)

    def max(self) -> Frame:
        return self._over(F.max)

    def std(self) -> Frame:
        return self._over(F.stddev_samp)


class Loc:
    """Access by label; the first row that bears it counts."""

    def __init__(self, frame: Frame):
        self._f = frame.with_labels()

    def _first(self, label: str) -> DataFrame:
        return self._f.sdf.where(F.col(INDEX) == label).orderBy(*self._f._order_columns()).limit(1)

    def at(self, label: str, column: str):
        self._f._need(column)
        if (row := self._first(label).select(F.col(f"`{column}`")).first()) is None:
            raise KeyError(f"no row {label!r}")
        return row[0]

    def is_null_at(self, label: str, column: str) -> bool:
        return self.at(label, column) is None

    def row(self, label: str) -> Frame:
        out = self._f._with(self._first(label))
        if out.sdf.isEmpty():
            raise KeyError(f"no row {label!r}")
        return out

    def rows(self, labels: list[str]) -> Frame:
        """A row per label, in the order of the list."""
        place = self._f._order_struct()
        whole = F.struct(*[F.col(f"`{c}`") for c in self._f.sdf.columns])
        found = self._f.sdf.where(F.col(INDEX).isin(list(labels))).groupBy(F.col(INDEX).alias("__l")).agg(F.min_by(whole, place).alias("r"))
        one = Frame(found.select("r.*"), self._f.order, True)
        known = {r[0] for r in one.sdf.select(INDEX).collect()}
        if missing := [x for x in labels if x not in known]:
            raise KeyError(f"no row {missing}")
        return one._gather(INDEX, list(labels), "string")

    def col(self, column: str) -> Column:
        return self._f.col(column)

    def cols(self, columns: list[str]) -> Frame:
        return self._f.select(*columns)


class ILoc:
    """Access by position, from 0; out of range is an error."""

    def __init__(self, frame: Frame):
        self._f, self._pos = frame.with_positions()

    def _column(self, at: int) -> str:
        if not 0 <= at < len(self._f.columns):
            raise IndexError(f"no column at {at}")
        return self._f.columns[at]

    def at(self, row: int, column: int):
        name = self._column(column)
        found = self._f.sdf.where(F.col(f"`{self._pos}`") == row).select(F.col(f"`{name}`")).first()
        if found is None:
            raise IndexError(f"no row at {row}")
        return found[0]

    def is_null_at(self, row: int, column: int) -> bool:
        return self.at(row, column) is None

    def row(self, row: int) -> Frame:
        return self._f.slice([row])

    def rows(self, positions: list[int]) -> Frame:
        return self._f.slice(positions)

    def range(self, start: int, end: int) -> Frame:
        """Rows [start, end)."""
        n = len(self._f)
        if not (0 <= start <= end <= n):
            raise IndexError(f"[{start}, {end}) of {n} rows")
        p = F.col(f"`{self._pos}`")
        return self._f._with(self._f.sdf.where((p >= start) & (p < end)))

    def col(self, at: int) -> Column:
        return self._f.col(self._column(at))

    def cols(self, positions: list[int]) -> Frame:
        return self._f.select(*[self._column(i) for i in positions])
