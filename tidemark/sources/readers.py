"""Sources. Files are read by Spark's distributed readers, lazily; workbooks
alone are parsed on the driver, as they are single zipped documents."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import POS, Frame
from ..functions import exprs
from ..types import LONG, is_integral, is_numeric, resolve
from . import xlsx


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    rows = spark.read.options(sep=sep, multiLine=True, escape='"').csv(path)
    first = rows.limit(1).collect() if rows.columns else []
    if not first:
        raise ValueError(f"{path} is empty")
    return [(c or "").lstrip("\ufeff") if i == 0 else c or "" for i, c in enumerate(first[0])]


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> Frame:
    """Header and strings; an empty cell is an empty string, never null. Rows
    with another number of cells than the header are dropped. A quoted cell may
    hold line breaks, so a file is read whole by one task; several files split."""
    names = _header(spark, path, sep)
    if len(set(names)) < len(names):
        raise ValueError(f"a column name repeats in {names}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    # With pruned columns the parser wouldn't look at the cells that show a row to be ragged.
    sdf = spark.read.schema(schema).options(header=True, sep=sep, mode="DROPMALFORMED", columnPruning=False, multiLine=True, escape='"').csv(path)
    sdf = sdf.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names], F.monotonically_increasing_id().alias(POS))
    return Frame(sdf, [POS])


def read_csv_typed(spark: SparkSession, path: str, types: dict, sep: str = ",") -> Frame:
    """As ``read_csv``, then typed: a number is read as far as it goes, truth
    words are known, anything else (and an empty cell) is null."""
    frame = read_csv(spark, path, sep)
    cells = [exprs.parse_prefix(F.col(f"`{c}`"), resolve(types[c])).alias(c) if c in types else F.col(f"`{c}`") for c in frame.columns]
    return frame._with(frame._project(cells), True)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> Frame:
    """An array of objects (or an object a ``line``, which splits): the union of
    their keys in text order; numbers are doubles, a missing key is null, nested
    values stay nested."""
    sdf = spark.read.option("multiLine", not lines).json(path)
    if not sdf.columns:
        raise ValueError(f"{path} holds no records")
    cells = [F.col(f"`{f.name}`").cast("double").alias(f.name) if is_numeric(f.dataType) else F.col(f"`{f.name}`") for f in sorted(sdf.schema, key=lambda f: f.name)]
    return Frame(sdf.select(*cells, F.monotonically_increasing_id().alias(POS)), [POS])


def read_parquet(spark: SparkSession, path: str) -> Frame:
    """Whole numbers are longs, fractional ones doubles; all else as stored. Rows
    are ordered by file and place in it."""
    sdf = spark.read.parquet(path)
    cells = []
    for f in sdf.schema:
        c = F.col(f"`{f.name}`")
        cells.append(c.cast(LONG).alias(f.name) if is_integral(f.dataType) else c.cast("double").alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    return Frame(sdf.select(*cells, *place), ["__file", "__row"])


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> Frame:
    """First (or named) sheet, first row as header, all strings; short rows are
    filled with empty strings."""
    rows = xlsx.read(path, sheet)
    if not rows:
        raise ValueError(f"{path} has no header")
    names = rows[0]
    data = [[(r[i] if i < len(r) else "") for r in rows[1:]] for i in range(len(names))]
    kinds = dict.fromkeys(names, "string")
    return Frame.from_rows(spark, names, data, kinds) if len(rows) > 1 else Frame.empty(spark, names, kinds)


def jdbc_url(driver: str, server: str, port: str | int, database: str) -> str:
    if driver == "sqlserver":
        return f"jdbc:sqlserver://{server}:{port};databaseName={database}"
    return f"jdbc:postgresql://{server}:{port}/{database}?sslmode=disable"


def jdbc_options(query: str, config: dict) -> dict[str, str]:
    """Reader options of a query over a connection (driver, server, port,
    database, username, password; partition_column, lower, upper and partitions
    to read in parallel)."""
    out = {"url": jdbc_url(config["driver"], config["server"], config["port"], config["database"]), "user": config["username"], "password": config["password"]}
    if "partition_column" in config:
        return out | {"dbtable": f"({query}) q", "partitionColumn": config["partition_column"], "lowerBound": str(config["lower"]), "upperBound": str(config["upper"]), "numPartitions": str(config["partitions"])}
    return out | {"query": query}


def read_sql(spark: SparkSession, query: str, config: dict | None = None) -> Frame:
    """A query over JDBC, or over the session's own views where no connection is
    given."""
    sdf = spark.sql(query) if config is None else spark.read.format("jdbc").options(**jdbc_options(query, config)).load()
    return Frame(sdf.withColumn(POS, F.monotonically_increasing_id()), [POS])


def bigquery_options(query: str, project: str) -> dict[str, str]:
    if not query or not project:
        raise ValueError("a query and a project are needed")
    return {"query": query, "parentProject": project, "viewsEnabled": "true"}


def read_bigquery(spark: SparkSession, query: str, project: str) -> Frame:
    """Needs the connector's jar on the session's class path."""
    sdf = spark.read.format("bigquery").options(**bigquery_options(query, project)).load()
    return Frame(sdf.withColumn(POS, F.monotonically_increasing_id()), [POS])
