"""Mixing sources to target weights.

Every document gets a hash-random 60-bit key. Within its source, documents are
ranged by that key: a tree of ranges, 256 to a node, holds the word counts of
each range, and prefix sums run down the tree. Only the range in which a
source's budget ends is sorted row by row, so the exact cut needs no window over
a whole source, and a source that holds a third of all rows costs no more than
any other. A budget above the source's size takes whole epochs first and cuts in
the last one; the document at the cut gives just the words that are missing.

Scale: each tree level is one aggregate with map-side combine, of at most 256
rows a source; the row-level sort reads 1/65536 of each source. The plan has one
row per source and is joined without a hint, so Catalyst broadcasts it by its
size or else sorts. No text is shuffled. Nothing is collected.

Defined results: a null text has size 0; a null source is a source of its own
and comes last in the order; rows that repeat an id (and so share a key) share
the words at the cut in proportion to their sizes; a source of size 0 takes
nothing. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import materialise, table, word_count

WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
OUTPUT = ("size", "source_size", "target", "taken", "epochs")


def random_key(c: Column, seed: str = "mix") -> Column:
    """60 uniform bits of MD5 over the id; reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its target. ``totals`` has (src, source_size).

    Sharing by weight with a cap of ``max_epochs`` times the size, the excess
    reshared until none is above, fills sources in the order of cap / weight: a
    source is capped if the level at its own cap is reached."""
    order = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    t = totals.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    fill = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = t.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("rest_w", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.col("left") / F.col("rest_w"))
    # The first source, in that order, whose ratio is not below the level fixes it for all that follow.
    t = t.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull() | (F.col("ratio") < F.col("final")), F.col("cap")).otherwise(F.col("w") * F.col("final"))
    return t.select("src", "source_size", F.round(target, 6).alias("target"))


def _descend(ranges: DataFrame, level: str) -> DataFrame:
    """``ranges``: (src, rest, <level>, words). The range in which ``rest`` more
    words end, with what is still missing at its start."""
    order = Window.partitionBy("src").orderBy(level)
    upto = ranges.withColumn("upto", F.sum("words").over(order))
    return upto.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest"))).select(
        "src", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), level
    )


def mixing_plan(docs: DataFrame, size: Column, id_col="doc_id", source_col="source", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed="mix") -> DataFrame:
    """One row per source: target, epochs, and the cut (key, id, words, rows)."""
    narrow = materialise(docs.select(F.col(source_col).alias("src"), F.col(id_col).alias("id"), random_key(F.col(id_col), seed).alias("key"), size.alias("size")), "mix")
    hi, lo = F.shiftright("key", 52).cast("int"), F.shiftright("key", 44).cast("int")
    top = narrow.groupBy("src", hi.alias("hi")).agg(F.sum("size").alias("words"))
    targets = source_targets(top.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    targets = targets.withColumn("budget", F.floor("target").cast("long"))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    targets = materialise(targets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "mix-targets")
    same = lambda a, b: F.col(f"{a}.src").eqNullSafe(F.col(f"{b}.src"))
    asked = targets.where("rest > 0").select("src", "rest")
    at = _descend(top.alias("a").join(asked.alias("b"), same("a", "b")).select("a.src", "rest", "hi", "words"), "hi")
    inside = narrow.withColumns({"hi": hi, "lo": lo}).alias("a").join(at.alias("b"), same("a", "b") & (F.col("a.hi") == F.col("b.hi")))
    at = _descend(inside.groupBy("a.src", "rest", "lo").agg(F.sum("size").alias("words")), "lo")
    inside = narrow.withColumn("lo", lo).alias("a").join(at.alias("b"), same("a", "b") & (F.col("a.lo") == F.col("b.lo")))
    rows = inside.groupBy("a.src", "rest", F.struct("key", "id").alias("at")).agg(F.sum("size").alias("words"))
    # Rows with one key and id are cut as one.
    cut = rows.withColumn("upto", F.sum("words").over(Window.partitionBy("src").orderBy("at"))).where(
        (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest"))
    ).select("src", "at", (F.col("rest") - F.col("upto") + F.col("words")).alias("cut_words"), F.col("words").alias("cut_size"))
    return targets.alias("a").join(cut.alias("b"), same("a", "b"), "left").select("a.src", "source_size", "target", "epochs", "at", "cut_words", "cut_size")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed="mix", size: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``epochs`` (whole copies)
    and ``taken`` (words). ``size`` is the number of words where it is known
    already; else the texts' words are counted, in both passes."""
    size = word_count(F.col(text_col)) if size is None else size
    plan = materialise(mixing_plan(docs, size, id_col, source_col, weights, share, max_epochs, seed), "mix-plan")
    base = docs.select(*[c for c in docs.columns if c not in OUTPUT])
    sized = base.withColumns({"__size": size, "__key": random_key(F.col(id_col), seed)})
    out = sized.alias("d").join(plan.alias("p"), F.col(f"d.{source_col}").eqNullSafe(F.col("p.src")))
    here, cut = F.struct(F.col("__key").alias("key"), F.col(f"d.{id_col}").alias("id")), F.col("p.at")
    size = F.col("__size")
    part = (
        F.when(cut.isNull(), F.lit(0))
        .when(here < cut, size)
        .when(here.eqNullSafe(cut), F.floor(size * F.col("cut_words") / F.greatest("cut_size", F.lit(1))))
        .otherwise(0).cast("long")
    )
    return out.select(
        *[F.col(f"d.{c}") for c in base.columns], size.alias("size"), "source_size", "target",
        (F.col("epochs") * size + part).alias("taken"), "epochs",
    )


def mixed_rows(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix itself: each document once per epoch that takes it; the copy at
    the cut ends with the last word taken. Columns are those of ``docs``."""
    # All columns ride in a struct, whatever their names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *dict.fromkeys([id_col, text_col, source_col]))
    m = mix(rows, id_col, text_col, source_col, **options)
    rest = F.col("taken") - F.col("epochs") * F.col("size")
    copies = m.withColumn("__words", F.explode(F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))
    # The text up to its word number __words: as many repeats of (gap, word).
    words = F.slice(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(F.col("__words").cast("int"), F.lit(0)))
    text = F.when(F.col("__words") >= F.col("size"), F.col(text_col)).otherwise(F.array_join(words, ""))
    return copies.select(*[text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "mix-words")
    return mix(counted, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
f AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT arg_min(level, ratio) FILTER (WHERE ratio >= level) AS final FROM f),
t AS (SELECT f.source, source_size, round(CASE WHEN final IS NULL OR ratio < final THEN cap ELSE f.w * final END, 6)::DOUBLE AS target FROM f, l),
p AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS epochs,
         CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - (upto - size))) AS BIGINT) AS taken FROM p
"""

QUERIES = {"op3_mixing": op3_mixing}
ORACLE = {"op3_mixing": SQL}
