"""URL filters: host and path rules first, then boosted trees.

A rule names a host and a path; it fits its host and all subdomains if the URL's
path starts with its path, and the longest fitting rule decides. All other URLs
are judged by gradient-boosted trees over lexical features: lengths, depth,
labels, digit ratio, entropy, parameters, and the record of the URL's suffixes
(top domain, and the last two labels) among the labelled URLs.

Scale: rules are expressions; features and trees are one map-side pass in Arrow
batches. Suffix records are counted over all labelled URLs, with map-side
combine, into a table of 2^SUFFIX_BITS hashed suffixes per level, so what the
driver gathers and the closure holds is bounded at any number of domains. Trees
are fitted in one task on a sample of about PER_CLASS labelled URLs of the larger
class, of which only the features travel; a training row's suffix records come
from other folds. The number of trees is the one with the least out-of-fold loss,
none included: labels that say nothing about URLs give the base rate.

Defined results: a null URL, or one without ``://``, has empty host and path, fits
no rule and is judged by its text (null: empty). Of rules of one length that fit,
the one given last decides. Without labels of both classes the method allows
everything. Null labels don't count; a labelled URL counts once for each label it
has. Repeated URLs are judged alike, very long ones whole (some 50 bytes of memory a
character). Input columns named like an output column are replaced; the URL column
itself may not be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import ascii_lower, table
from ._learn import fit_in_a_task, hash_unit
from ._text import mix64, pieces

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PER_CLASS, SUFFIX_BITS, PRIOR, FOLDS = 10_000, 14, 20.0, 5
TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.1, 32, 20
#: Probability from which on the method blocks.
BLOCK = 0.5
OUTPUT = ("host", "path", "rule", "verdict", "p_block")
_PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def suffixes(host: Column) -> list[Column]:
    """Last label, and last two labels, as buckets of the record table."""
    part = lambda n: F.pmod(F.xxhash64(F.substring_index(host, ".", -n)), F.lit(1 << SUFFIX_BITS)).cast("int")
    return [part(1), part(2)]


def lexical(url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
    """(urls, features) that need no label."""
    url, host, path = (pc.fill_null(x.take(pa.array(np.arange(len(x)))).cast(pa.large_string()), "") for x in (url, host, path))
    num = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64)
    size = num(pc.utf8_length(url))
    points = np.frombuffer("".join(url.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(size)), size.astype(np.int64))
    kind, n = np.unique(of * np.int64(1 << 21) + points, return_counts=True)
    share = n / size[kind >> 21]
    entropy = np.bincount(kind >> 21, -share * np.log2(share), minlength=len(size))
    count = lambda a, p: num(pc.count_substring_regex(a, p))
    digits = count(url, "[0-9]")
    return np.stack([
        size, num(pc.utf8_length(host)), num(pc.utf8_length(path)), count(path, "/[^/]"), count(host, r"\.") + 1, digits / np.maximum(size, 1),
        count(host, "[0-9]"), entropy, count(url, r"[?&][^=&#?]+"), count(host, "-"), count(path, "-"), count(url, "%[0-9A-Fa-f]{2}"),
        num(pc.starts_with(url, "https")), num(pc.match_substring(url, "#")), count(path, r"\.[A-Za-z0-9]+$"), num(pc.starts_with(host, "www.")),
    ], axis=1)


def _with_records(x: np.ndarray, buckets: list[np.ndarray], records: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """The rate of label 1 and the (log) count of each suffix appended.
    ``records``: (folds, levels, buckets, 2) rows and ones; a training row's
    record is that of the other folds, scaled up, so that it can't tell its label."""
    total = records.sum(axis=0)
    base = (total[0, :, 1].sum() + 1) / (total[0, :, 0].sum() + 2)
    more = []
    for level, b in enumerate(buckets):
        seen = total[level, b].astype(float)
        if fold is not None:
            seen = (seen - records[fold, level, b]) * FOLDS / (FOLDS - 1)
        more += [(seen[:, 1] + PRIOR * base) / (seen[:, 0] + PRIOR), np.log1p(seen[:, 0])]
    return np.concatenate([x, np.stack(more, axis=1)], axis=1).astype(np.float32)


class Trees:
    """Boosted complete trees of one depth for the logistic loss; cuts at
    quantiles of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES):
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for j in range(d)]
        cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        inner = 2**DEPTH - 1
        self.feature, self.cut, self.leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**DEPTH))
        z = np.full(n, self.base)
        for t in range(trees):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                self._split(t, first, width, node, code, cuts, g, h)
                f = self.feature[t, first + node]
                node = 2 * node + (x[np.arange(n), f] > self.cut[t, first + node])
            sum_g, sum_h = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
            self.leaf[t] = RATE * sum_g / (sum_h + 1.0)
            z += self.leaf[t][node]

    def _split(self, t, first, width, node, code, cuts, g, h) -> None:
        best = np.zeros(width)
        rows = np.bincount(node, minlength=width)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            at = node * (len(c) + 1) + code[:, j]
            G, H, N = (np.bincount(at, w, width * (len(c) + 1)).reshape(width, -1) for w in (g, h, None))
            GL, HL, NL = (np.cumsum(a, axis=1)[:, :-1] for a in (G, H, N))
            GA, HA = G.sum(axis=1, keepdims=True), H.sum(axis=1, keepdims=True)
            gain = GL**2 / (HL + 1) + (GA - GL) ** 2 / (HA - HL + 1) - GA**2 / (HA + 1)
            gain[(NL < LEAST) | (rows[:, None] - NL < LEAST)] = 0
            k = gain.argmax(axis=1)
            top = gain[np.arange(width), k]
            better = top > best + 1e-12
            best[better] = top[better]
            at = first + np.flatnonzero(better)
            self.feature[t, at], self.cut[t, at] = j, c[k[better]]

    def margins(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Log odds by the base rate, and after each tree."""
        z = np.full(len(x), self.base)
        yield z
        rows = np.arange(len(x))
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            z = z + self.leaf[t][node - (2**DEPTH - 1)]
            yield z

    def probability(self, x: np.ndarray) -> np.ndarray:
        for z in self.margins(x):
            pass
        return 1 / (1 + np.exp(-z))


def boosted(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[Trees, float]:
    """The trees, as many as have the least out-of-fold loss, and the area under
    the curve of their out-of-fold margins."""
    margins = np.zeros((TREES + 1, len(y)))
    for k in range(FOLDS):
        own = fold == k
        if own.any() and not own.all():
            margins[:, own] = np.stack(list(Trees(x[~own], y[~own]).margins(x[own])))
    loss = np.logaddexp(0, np.where(y == 1, -margins, margins)).mean(axis=1)
    best = int(loss.argmin())
    return Trees(x, y, best), _area(margins[best], y)


def _area(z: np.ndarray, y: np.ndarray) -> float:
    """Chance that a row of label 1 has more than one of label 0; ties count half."""
    value, at, n = np.unique(z, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    ones = int(y.sum())
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / max(ones * (len(y) - ones), 1))


def train(labelled: DataFrame, url: str = "url", label: str = "label", per_class: int = PER_CLASS):
    """(trees, records, out-of-fold area) from URLs labelled 1 (block) or 0; None
    without both."""
    usable = labelled.where(F.col(label).isin(0, 1) & F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("int").alias("label")).distinct()
    host = host_of(F.col("url"))
    rows = usable.select("url", host.alias("host"), path_of(F.col("url")).alias("path"), "label", F.pmod(F.xxhash64(F.col("url"), F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), *[s.alias(f"s{k}") for k, s in enumerate(suffixes(host))])
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"s{k}").alias("b")) for k in range(2)]))
    records = np.zeros((FOLDS, 2, 1 << SUFFIX_BITS, 2), np.int32)
    for fold, level, b, n, ones in rows.select("fold", levels.alias("x"), "label").groupBy("fold", "x.level", "x.b").agg(F.count(F.lit(1)), F.sum("label")).collect():
        records[fold, level, b] = n, ones
    n, ones = records[:, 0].sum(axis=(0, 1))
    if not 0 < ones < n:
        return None

    def features(b: pa.RecordBatch) -> np.ndarray:
        return _with_records(lexical(b.column("text"), b.column("host"), b.column("path")), [b.column(f"s{k}").to_numpy() for k in range(2)], records, b.column("fold").to_numpy())

    def fit(x: np.ndarray, labels: list, h: np.ndarray):
        trees, area = boosted(x, np.array(labels, float), (mix64(h.view(np.uint64)) % np.uint64(FOLDS)).astype(int))
        return vars(trees), area

    # Classes keep their shares: about per_class rows of the larger one.
    share = min(1.0, per_class / max(ones, n - ones))
    sample = rows.where(hash_unit(F.col("url")) < share).withColumn("key", F.struct("url", "label")).withColumnRenamed("url", "text")
    trees = Trees.__new__(Trees)
    parts, area = fit_in_a_task(sample, features, fit)
    vars(trees).update(parts)
    return trees, records.sum(axis=0, keepdims=True), area


def judge(pages: DataFrame, model, url_col: str = "url", rules=RULES, block: float = BLOCK) -> DataFrame:
    """``pages`` with host, path, rule, verdict and p_block (null without a model)."""
    base = pages.select(*[c for c in pages.columns if c not in OUTPUT])
    url = F.col(url_col)
    host = host_of(url)
    cut = base.select("*", host.alias("host"), path_of(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    if model is None:
        p = F.lit(None).cast("double")
    else:
        trees, records, _ = model

        kinds = [pa.large_string()] * 3 + [pa.int32()] * 2

        @F.pandas_udf("double")
        def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                batch = pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip(columns, kinds, strict=True)], ["url", "host", "path", "s0", "s1"])
                parts = [lexical(*[piece.column(k) for k in range(3)]) for piece in pieces([batch], "url")]
                x = _with_records(np.concatenate(parts), [batch.column(k).to_numpy() for k in (3, 4)], records)
                yield pd.Series(trees.probability(x))

        p = probability(url, F.col("host"), F.col("path"), *suffixes(F.col("host")))
    return cut.withColumn("p_block", p).select(
        *base.columns, "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("p_block") >= block, "block").otherwise("allow")).alias("verdict"), "p_block"
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs with label 1 where the document they name was judged of low quality."""
    number = F.expr(r"try_cast(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS BIGINT)")
    known = labels.select(F.col("doc_id").alias("number"), (1 - F.col("quality")).alias("label"))
    return pages.select("url", number.alias("number")).join(known, "number").select("url", "label")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = train(labelled_pages(pages, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "p_block")


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE: dict = {}
