"""Corpus-wide line de-duplication.

Lines are exploded, normalised (stripped, A-Z folded) and hashed to 128 bits;
distinct documents are counted per hash; a line of at least ``min_chars`` code
points found in ``min_docs`` documents or more stays only in the largest
document id that holds it. What is left is put together again by position.

Scale: only (document, hash, position) triples are shuffled, never line texts.
``count(distinct)`` first groups by (hash, document), so one line that stands in
a third of all documents is spread over every task; the join that finds the
dropped positions is an ordinary equi-join, which adaptive execution splits where
a key is hot. Each document's text moves once at most, in the last join.

Defined results: a null or empty text is one empty line. A row with a null id
keeps all its lines and isn't counted. Rows that repeat an id count as one
document and are all returned. Other input columns are passed through; an input
column named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import ascii_lower, materialise, strip, table

MIN_CHARS, MIN_DOCS = 20, 3


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``."""
    spark_id, text = F.col(id_col), F.col(text_col)
    narrow = docs.select(spark_id.alias("__id"), F.xxhash64(text).alias("__th"), F.posexplode(_lines(text)).alias("__pos", "__line"))
    narrow = narrow.where(F.length("__line") >= min_chars).withColumn("__key", strip(F.col("__line"))).where(F.length("__key") >= min_chars)
    narrow = narrow.withColumn("__key", ascii_lower(F.col("__key")))
    # Two seeds of one 64-bit hash: 128 bits, so that 10^12 lines don't collide.
    lines = narrow.select("__id", "__th", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), F.col("__key")).alias("__h2"))
    lines = materialise(lines, "lines")  # read twice: for the counts, and for the places to drop
    common = (
        lines.where(F.col("__id").isNotNull())
        .groupBy("__h1", "__h2").agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__last"))
        .where(F.col("__n") >= min_docs).select("__h1", "__h2", "__last")
    )
    common = materialise(common, "common-lines")  # so that the join below can be split where a line is hot
    gone = (
        lines.join(common, ["__h1", "__h2"]).where(F.col("__id") < F.col("__last"))
        .groupBy("__id", "__th").agg(F.collect_set("__pos").alias("__gone"))
    )
    base = docs.select(*[c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")])
    out = base.withColumn("__th", F.xxhash64(F.col(text_col))).alias("d").join(gone.alias("g"), (F.col(f"d.{id_col}") == F.col("g.__id")) & (F.col("d.__th") == F.col("g.__th")), "left")
    t = F.coalesce(F.col(f"d.{text_col}"), F.lit(""))
    # The outer transform binds the lines once; array_except is linear in both sides.
    kept = F.transform(
        F.array(_lines(t)),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__gone")), lambda i: F.get(ls, i)), "\n"),
    )[0]
    return out.select(
        *[F.col(f"d.{c}") for c in base.columns],
        F.when(F.col("__gone").isNull(), t).otherwise(kept).alias("kept_text"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH src AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM src),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
flagged AS (
  SELECT keyed.*, (c.k IS NOT NULL AND doc_id < last_doc) AS gone FROM keyed LEFT JOIN common c ON keyed.k = c.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE = {"op2_line_dedup": SQL}
