"""Personal data: exact base patterns, and bootstrapped contextual extraction.

1. Base: e-mail, IP, card and phone spans by pattern and check, in code points.
2. The base spans are seeds; so are, for the kind ``secret``, words whose core (the
   word without the punctuation around it) is 32, 40 or 64 hexadecimal digits. The
   words around a seed induce lexical patterns: its two words to the left, the one
   to the left, and that with the one to the right. Words are runs of anything but
   white space, so punctuation counts: ``token = "`` gives ``token =`` and ``=``.
3. Patterns and instances (distinct values) form a graph. A seed has score 1; a
   pattern's score is the mean score of the distinct instances it occurs with,
   smoothed; an instance that is no seed has the noisy-or of its patterns. The
   scores are iterated ``ROUNDS`` times.
4. Candidates (words with an @ or at least four digits, outside of base spans)
   whose patterns are confident, ``CONFIDENT`` or more with ``SUPPORT`` distinct
   seeds or more, are new spans of the seeds' kind: the word's core. A secret's
   shape alone makes no span, its context must be confident too.

Scale: texts are scanned once, and only spans with their patterns are written and
shuffled. The graph is cut at once to patterns with enough seeds; edges are made
distinct before they are counted, so a passage repeated in a third of all
documents is one edge, and hot patterns are pre-aggregated. Nothing is collected.
Matching is linear in a text and needs no stack; the places of n matches take
O(n log n), and context words are found by looking away from a match, so that a
match costs the text up to its neighbours and no more. A text is one row's work.

Defined results: a null text is empty. Rows that repeat an id are judged each by
its own text. No document, or no seed, gives no new spans. Of confident patterns
of several kinds the best score decides, then the kind listed first. Context
reaches up to the match of the same kind before or after, whole words whatever
their length; an incomplete pattern is left out. Other columns don't take part,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import below, bound, materialise, prefix_sums, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SUPPORT, CONFIDENT, SMOOTH, ROUNDS = 5, 0.8, 0.5, 3
#: A word of more code points goes by its MD5 in a pattern.
LONG = 64
_WS = r"\x20\x09-\x0D"
#: The same languages as the plain patterns; possessive, and begun only where a match can begin.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
#: What a text must hold to have a match: a cheap first look.
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_CANDIDATE = rf"(?<![^{_WS}])(?=(?:[^{_WS}0-9]*+[0-9]){{4}}|[^{_WS}@]*+@)[^{_WS}]++"
_SECRET = r"^(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
_MATCH = "array<struct<before:string,m:string,after:string>>"


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Each leftmost, non-overlapping match with the pieces of text before and
    after it, up to the next match."""
    rows = bound(
        F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")),
        lambda x: F.transform(x["m"], lambda m, i: F.struct(F.get(x["p"], i).alias("before"), m.alias("m"), F.get(x["p"], i + 1).alias("after"))),
    )
    return F.when(text.rlike(hint) & text.rlike(pattern), rows).otherwise(F.array().cast(_MATCH))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a context, as an array of strings: the two words
    to the left; the one; it and the one to the right. Incomplete ones are left out."""
    name = lambda w: F.when(F.length(w) > LONG, F.md5(w)).otherwise(F.lower(w))
    back = rf"^[{_WS}]*+([^{_WS}]++)(?:[{_WS}]++([^{_WS}]++))?"

    def of(left: Column) -> Column:
        one, two = (name(F.reverse(F.regexp_extract(left, back, k))) for k in (1, 2))
        return F.transform(F.array(F.struct(one.alias("one"), two.alias("two"), name(F.regexp_extract(after, back, 1)).alias("next"))), lambda w: F.array(
            F.when((w["one"] != "") & (w["two"] != ""), F.concat_ws(" ", F.lit("L"), w["two"], w["one"])),
            F.when(w["one"] != "", F.concat_ws(" ", F.lit("O"), w["one"])),
            F.when((w["one"] != "") & (w["next"] != ""), F.concat_ws(" ", F.lit("B"), w["one"], w["next"])),
        ))[0]

    return F.filter(bound(F.reverse(before), of), lambda p: p.isNotNull())


def _spans(rows: Column) -> Column:
    """(start, end, value, patterns) of matches."""
    ends = prefix_sums(F.transform(rows, lambda r: F.length(r["before"]) + F.length(r["m"])))
    return bound(ends, lambda e: F.transform(rows, lambda r, i: F.struct((F.get(e, i) - F.length(r["m"])).alias("start"), F.get(e, i).alias("end"), r["m"].alias("value"), _patterns(r["before"], r["after"]).alias("patterns"))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""

    def add(total, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # leading zeros don't count
        return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(value))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _of_kind(n: int, kind: str, spans: Column) -> Column:
    return F.transform(F.filter(spans, lambda s: _valid(kind, s["value"])), lambda s: F.struct(F.lit(n).alias("kind"), s.alias("s")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, base, candidates): th tells texts of one id apart; base is an
    array of (kind number, span), candidates one of spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array(*[_matches(text, _PATTERN[k], _HINT[k]) for k in BASE], _matches(text, _CANDIDATE, "[0-9@]"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), found.alias("found"))
    rows = rows.select("id", "th", F.transform("found", _spans).alias("found"))
    base = F.concat(*[_of_kind(n, k, F.get("found", n)) for n, k in enumerate(BASE)])
    rows = rows.select("id", "th", base.alias("base"), F.get("found", len(BASE)).alias("tokens"))
    sides = F.struct(F.array_sort(F.transform("base", lambda b: b["s"]["start"])).alias("start"), F.array_sort(F.transform("base", lambda b: b["s"]["end"])).alias("end"))
    # As many base spans begin before a token's end as end up to its start: none overlaps it.
    free = bound(sides, lambda x: F.filter("tokens", lambda t: below(x["start"], t["end"]) == below(x["end"], t["start"] + 1)))
    return rows.select("id", "th", "base", F.when(F.size("base") == 0, F.col("tokens")).otherwise(free).alias("candidates"))


def _core(value: Column) -> tuple[Column, Column]:
    """The word without the punctuation around it, and the length of what is before."""
    lead = F.length(F.regexp_extract(value, r"^[^\p{L}\p{N}+]*+", 0))
    return F.regexp_replace(F.substr(value, lead + 1), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", ""), lead


def graph(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates with each of their patterns that has enough seeds, and the
    scored patterns: (pattern, kind, seeds, n, score)."""
    core, lead = _core(F.col("c.value"))
    tokens = scanned.select("id", "th", F.explode("candidates").alias("c")).select("id", "th", (F.col("c.start") + lead).alias("start"), core.alias("core"), "c.patterns")
    tokens = tokens.where("core != ''").select("id", "th", "start", "core", F.col("core").rlike(_SECRET).alias("secret"), F.explode("patterns").alias("pattern"))
    known = scanned.select(F.explode("base").alias("b")).select(F.col("b.kind").alias("kind"), F.lower("b.s.value").alias("value"), F.explode("b.s.patterns").alias("pattern"))
    secret = tokens.where("secret").select(F.lit(len(BASE)).alias("kind"), F.lower("core").alias("value"), "pattern")
    seeds = materialise(known.unionByName(secret).distinct(), "pii-seeds")
    strong = materialise(seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= SUPPORT), "pii-patterns")
    tokens = materialise(tokens.join(strong.select("pattern").distinct(), "pattern"), "pii-tokens")
    # All instances of a pattern count: seeds of another kind are instances of score 0.
    unknown = tokens.where("NOT secret").select("pattern", F.lower("core").alias("value")).distinct()
    sizes = seeds.join(strong.select("pattern").distinct(), "pattern").select("pattern", "value").unionByName(unknown).distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    cut = materialise(strong.join(sizes, "pattern"), "pii-graph")
    edges = unknown.join(cut.select("pattern", "kind"), "pattern")
    score = F.col("mass") / (F.col("n") + SMOOTH)
    patterns = cut.select("pattern", "kind", "seeds", "n", (F.col("seeds").cast("double") / (F.col("n") + SMOOTH)).alias("score"))
    for _ in range(ROUNDS):
        # Noisy-or over the patterns of a value: 1 - prod(1 - score).
        held = edges.join(patterns.select("pattern", "kind", "score"), ["pattern", "kind"])
        values = held.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("v"))
        gained = edges.join(values, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("v").alias("gained"))
        patterns = cut.join(gained, ["pattern", "kind"], "left").withColumn("mass", F.col("seeds") + F.coalesce("gained", F.lit(0.0)))
        patterns = materialise(patterns.select("pattern", "kind", "seeds", "n", F.least(score, F.lit(1.0)).alias("score")), "pii-scores")
    return tokens, patterns


def discover(scanned: DataFrame) -> DataFrame:
    """(id, th, kind, start, end) of new spans."""
    tokens, patterns = graph(scanned)
    # A pattern must earn its confidence by seeds: the mass that its own finds lend counts half.
    sure = patterns.where((F.col("score") >= CONFIDENT) & (2 * F.col("seeds") >= F.col("n")))
    best = tokens.join(sure.select("pattern", "kind", "score"), "pattern").groupBy("id", "th", "start", "core").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return best.select("id", "th", "kind", "start", (F.col("start") + F.length("core")).alias("end"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans): arrays of (kind number, start, end), by kind, then
    start; ``spans`` has the base spans and the new ones."""
    scanned = materialise(scan(docs, id_col, text_col), "pii-scan")
    new = discover(scanned).groupBy("id", "th").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"]["start"].alias("start"), b["s"]["end"].alias("end")))
    a, b = scanned.select("id", "th", base.alias("base")).alias("a"), new.alias("b")
    joined = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")), "left")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), F.col("new"))))
    return joined.select(F.col("a.id").alias(id_col), "base", spans.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict = {}
