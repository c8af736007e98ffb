"""What the operators of this subpackage share: reading tables, materialised
intermediates in the cluster's shared folder, and exact ASCII text primitives.

Text rules used throughout: white space is ``[\\x20\\x09-\\x0D]`` and nothing
else, and case folding touches ``A-Z`` only.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``; where that is unset, a fresh local one in local mode
    (tests), and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. This cuts
    the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def sweep() -> None:
    """Deletes what ``materialise`` wrote. Results are lazy and read it, so this
    is for when they have been used; it runs when the driver ends."""
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    while _written:
        path = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        sweep()


def local_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few rows from the driver's memory, as one literal that the JVM reads:
    no Python worker takes part."""
    names = [f.name for f in T._parse_datatype_string(schema)]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(T._parse_datatype_string(schema)))))


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(c)`` with ``c`` worked out once, however often ``fn`` uses it."""
    return F.transform(F.array(c), fn)[0]


def prefix_sums(lengths: Column) -> Column:
    """Running sums of an array of whole numbers, each with its own, in
    O(n log n): after round k an element holds the sum of the last 8^k."""

    def doubled(a: Column, k: Column) -> Column:
        reach = F.pow(F.lit(8.0), k).cast("int")
        return F.transform(a, lambda x, i: F.aggregate(F.sequence(F.lit(0), F.least(F.floor(i / reach).cast("int"), F.lit(7))), x - x, lambda s, j: s + F.get(a, i - j * reach)))

    def rounds(a: Column) -> Column:
        last = F.ceil(F.length(F.bin(F.size(a) - 1)) / 3).cast("int") - 1
        return F.when(F.size(a) < 2, a).otherwise(F.aggregate(F.sequence(F.lit(0), last), a, doubled))

    return bound(lengths, rounds)


def below(ascending: Column, value: Column) -> Column:
    """How many elements of a sorted array are less than ``value``, by bisection."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less, open_ = F.get(ascending, mid) < value, s["lo"] < s["hi"]
        return F.struct(F.when(open_ & less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~less, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(ascending).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ascending)))), start, halve, lambda s: s["lo"])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other characters untouched. ``lower`` is exact when every
    non-ASCII character is one of U+00DF..U+00FF (no upper case among them), and
    is far cheaper than ``translate``, which serves the other strings."""
    return F.when(c.rlike("[^\\x00-\\x7F\\u00DF-\\u00FF]"), F.translate(c, _UPPER, _LOWER)).otherwise(F.lower(c))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty. One more than the gaps
    between words, which needs no array of words."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit(WORD))).cast("long")
