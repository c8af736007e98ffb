"""Sharding by sampled splitters, under the ``bytes`` law: sizes near equal.

Records are ordered by (60-bit hash of the text, id, hash of the other columns).
A size-weighted key sample is drawn, its quantile boundaries are the splitters,
and records are range-partitioned by them. Ranges that turn out overfull are
subdivided by splitters drawn inside them, and so is a range in which a shard
should end, until it holds at most ``FINE`` of all bytes. A shard is a run of
whole ranges: each range goes to the shard in which its middle byte falls.

A splitter stands before a group of equal texts, so that a group stays in one
shard, unless the group holds over ``KEEP_PART`` of a shard: a group with a third
of all rows is a range to subdivide like any other, by id and then by the other
columns. Rows equal in all columns are counted and dealt out by number.

Scale: records are ranged and numbered as keys, without text; a range is numbered
on its own, and there are up to MAX_RANGES of them, as the rows grow. Texts are
shuffled once, to meet their numbers, each under a key of its own; the number of
tasks is Spark's to choose. Driver: the key sample (bounded by the number of
ranges) and a row per range.

Defined results: a null text has no bytes and size 1, as an empty one has; null
ids come first, ids that aren't numbers go by a hash; rows repeated exactly are
interchangeable and get slots of their own, rows that differ in a carried column
don't change places between runs. An empty table gives no rows. Input columns named
like an output column are replaced; names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import below, local_rows, materialise, table

SHARDS = 8
#: Splitter sample and ranges: bounds, whatever the input. A range is meant to hold ROWS rows.
SAMPLE_PER_RANGE, MIN_RANGES, MAX_RANGES, ROWS = 16, 1024, 16_384, 50_000
#: A range of over this many times the mean is subdivided, in at most ROUNDS rounds.
OVERFULL, ROUNDS = 2.0, 6
#: Part of all bytes that a range in which a shard ends may hold; parts it is cut into.
FINE, PARTS = 2.0**-16, 32
#: Groups of equal texts of up to this part of a shard stay whole.
KEEP_PART = 0.01
OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Bits of the hash below its 16 leading ones.
_COARSE, _LEAST = 44, -(2**63)
_KEY = ("__k", "__i", "__h", "__p")
_STRUCT = "struct<k:bigint,i:bigint,h:bigint,p:bigint>"

Key = tuple[int, int, int, int]


def text_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _ranged(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """``rows`` with __r, the number of splitters at or before the record. The
    lookup table has a row for each of 2^16 hash prefixes, so its broadcast is
    bounded: below 4 MB and about MAX_RANGES splitters."""
    inner: dict[int, list] = {}
    for k in splitters:
        inner.setdefault(k[0] >> _COARSE, []).append(k)
    spark, n = rows.sparkSession, 0
    starts = []
    for c in sorted(inner):
        starts.append((c, n, [dict(zip("kihp", k, strict=True)) for k in inner[c]]))
        n += len(inner[c])
    own = local_rows(spark, starts, f"__c int, __before int, __own array<{_STRUCT}>")
    # Prefixes without a splitter of their own take the count before the next one.
    ends = [(-1, 0), *[(c, b + len(o)) for c, b, o in starts]]
    steps = local_rows(spark, [(a, b, n) for (a, n), b in zip(ends, [*[c for c, _ in ends[1:]], 1 << 16], strict=True)], "a int, b int, n int")
    steps = steps.where("b - a > 1").select(F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("__c"), F.col("n").alias("__before"), F.array().cast(f"array<{_STRUCT}>").alias("__own"))
    after = F.struct(*[F.col(c).alias(n) for c, n in zip(_KEY[:3], "kih", strict=True)], (F.col("__p") + 1).alias("p"))
    found = rows.withColumn("__c", F.shiftright("__k", _COARSE).cast("int")).join(F.broadcast(own.unionByName(steps)), "__c")
    inside = F.when(F.size("__own") == 0, F.lit(0)).otherwise(below(F.col("__own"), after))
    return found.withColumn("__r", F.col("__before") + inside).drop("__c", "__before", "__own")


def _before_group(k: int) -> Key:
    return (k, _LEAST, _LEAST, 0)


def _splitters(sample: list[Key], parts: int, whole: bool) -> set[Key]:
    """Quantile boundaries of a size-weighted sample. ``whole``: before groups of
    equal texts, and behind one that several quantiles fall into."""
    keys = sorted(sample)
    cuts = [keys[len(keys) * j // parts] for j in range(1, parts)] if keys else []
    if not whole:
        return set(cuts)
    hashes = [c[0] for c in cuts]
    return {_before_group(k) for k in hashes} | {_before_group(a + 1) for a, b in zip(hashes, hashes[1:], strict=False) if a == b}


def _draw(rows: DataFrame, steps: DataFrame, salt: int) -> dict[int, list[Key]]:
    """Keys of ranges: of each range in ``steps`` (__r, __step), rows with a chance
    in proportion to their size: floor(size / step + u) draws, u hash-uniform, so
    twice as many as were asked for at most."""
    u = F.pmod(F.xxhash64(*_KEY, F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = rows.join(F.broadcast(steps), "__r").where(F.floor(F.col("__t") / F.col("__step") + u) >= 1)
    out: dict[int, list[Key]] = {}
    for r, *key in drawn.select("__r", *_KEY).collect():
        out.setdefault(r, []).append(tuple(key))
    return out


def _sums(rows: DataFrame, splitters: list[Key]) -> list:
    """(range, bytes, records, least and greatest hash), in order."""
    return _ranged(rows, splitters).groupBy("__r").agg(F.sum("__t"), F.sum("__n"), F.min("__k"), F.max("__k")).orderBy("__r").collect()


def choose_splitters(rows: DataFrame, total: int, count: int, shards: int = SHARDS) -> tuple[list[Key], list]:
    """Splitters, and ``_sums`` of their ranges. ``rows``: the key, __t bytes, __n records."""
    spark = rows.sparkSession
    ranges = max(MIN_RANGES, min(MAX_RANGES // 2, count // ROWS))
    steps = lambda asked: local_rows(spark, [(r, max(1.0, s / (SAMPLE_PER_RANGE * p))) for r, s, p in asked], "__r int, __step double")
    first = _draw(rows.withColumn("__r", F.lit(0)), steps([(0, total, ranges)]), 0).get(0, [])
    splitters = sorted(_splitters(first, ranges, True))
    for salt in range(1, ROUNDS + 1):
        sums, at, asked, groups = _sums(rows, splitters), 0, [], set()
        for r, s, _, least, greatest in sums:
            ends = at * shards // total != (at + s) * shards // total and (at + s) < total and s > FINE * total
            if (ends or s > OVERFULL * total / ranges) and (least < greatest or s * shards > KEEP_PART * total):
                asked.append((r, s, max(PARTS if ends else 2, 1 + int(s * ranges / total))))
                if least == greatest:
                    groups.add(r)
            at += s
        if not asked or len(splitters) >= MAX_RANGES or salt == ROUNDS:
            break
        drawn = _draw(_ranged(rows, splitters), steps(asked), salt)
        more = set(splitters).union(*[_splitters(drawn.get(r, []), p, r not in groups) for r, _, p in asked])
        if len(more) == len(splitters):  # records that nothing can part
            break
        splitters = sorted(more)
    return splitters, sums


def shard(docs: DataFrame, id_col="doc_id", text_col="text", shards: int = SHARDS, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (of which the columns ``carry``; all by default) with size,
    text_crc32, law, shard, slot and grown_shard."""
    columns = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUT]
    narrow = [F.col(f"`{c}`") for c in columns if c != text_col]
    kind = docs.schema[id_col].dataType.typeName()
    number = F.col(id_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    key = [text_hash(F.col(text_col)).alias("__k"), F.coalesce(number, F.lit(_LEAST)).alias("__i"), F.xxhash64(*narrow, F.lit(0)).alias("__h")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(*narrow, *key, F.col(text_col).isNull().alias("__null"), (F.octet_length(text) + 1).cast("long").alias("__s"), F.crc32(text.cast("binary")).alias("__crc"))
    # Rows equal in everything are one row of this table.
    rows = materialise(keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("__copies")), "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum(F.col("__s") * F.col("__copies")), F.lit(0)), F.coalesce(F.sum("__copies"), F.lit(0))).first()
    # ... cut into portions, so that many copies can be parted.
    portion = F.greatest(F.lit(1), F.floor(F.lit(FINE * total) / F.col("__s"))).cast("long")
    rows = rows.withColumn("__portion", portion).withColumn("__p", F.explode(F.expr("sequence(0L, (__copies - 1) div __portion)")))
    rows = rows.withColumn("__n", F.expr("least(__portion, __copies - __p * __portion)")).withColumn("__t", F.col("__n") * F.col("__s"))
    splitters, sums = choose_splitters(rows, total, count, shards) if count else ([], [])
    starts, byte, row, first = [], 0, 0, {}
    for r, s, n, _, _ in sums:
        own = min(shards - 1, (2 * byte + s) * shards // (2 * total))
        starts.append((r, own, row - first.setdefault(own, row)))
        byte, row = byte + s, row + n
    # A row per range, so this broadcast is bounded as MAX_RANGES is.
    place = F.broadcast(local_rows(docs.sparkSession, starts, "__r int, __shard int, __n0 bigint"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__r").orderBy(*_KEY, "__null").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = _ranged(rows, splitters).withColumn("__at", before).join(place, "__r")
    numbered = numbered.withColumn("__nth", F.explode(F.expr("sequence(0L, __n - 1)")))
    if text_col in columns:
        numbered = _with_texts(numbered, docs.select(*key, F.col(text_col).alias("__text")))
    return numbered.select(
        *[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in columns], F.col("__s").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), (F.col("__n0") + F.col("__at") + F.col("__nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_texts(numbered: DataFrame, texts: DataFrame) -> DataFrame:
    """The numbered rows with __text. Rows that stand alone meet their own text;
    for copies one text is enough, found by an aggregate with map-side combine, so
    that no key brings many texts together."""
    same = ["__k", "__i", "__h", "__null"]
    texts = texts.withColumn("__null", F.col("__text").isNull())
    many = numbered.where("__copies > 1").select(*same).distinct()
    if many.isEmpty():
        return numbered.join(texts, same)
    many = materialise(many, "shard-copies")
    one = texts.join(many, same, "left_semi").groupBy(*same).agg(F.first("__text").alias("__text"))
    alone = numbered.where("__copies = 1").join(texts, same)
    return alone.unionByName(numbered.where("__copies > 1").join(one, same).select(alone.columns))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, carry=["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op8_sharding": op8_sharding}
ORACLE: dict = {}
