"""Quality rules: base statistics of each text, and a learned verdict.

The base rules are exact statistics of whole texts. The verdict of the others is
a logistic regression over hashed word (orders 1, 2) and character (1 to 3)
n-grams, trained on labelled quality rows and calibrated on a fold that the fit
doesn't see, scored in Arrow batches: a text is dropped if its calibrated
probability of low quality is at least ``DROP``.

Scale: one map-side pass, no shuffle; words, 8-word windows and n-grams of a
batch are worked out together. Runs of words get exact ids by doubling (pairs of
ids are numbered anew, three times), so no hash decides on a repeat. Training
takes about ``PER_CLASS`` labelled texts of each class: features where the texts
are, the fit in one task. Rows go by a hash there and into folds by a hash, so
reruns agree. A very long text is read whole; its statistics take some 100 bytes
a word while it is looked at.

Defined results: a null or empty text has no words and fails the base rules. With
labels of one class, or none, the verdict keeps all that passes the base rules.
Null labels and null ids don't count; an id with labels of both kinds counts as
low, and of several rows of a labelled id one is trained on. Repeated rows are
judged alike. A probability of just ``DROP`` drops. ids keep their type; other
columns don't take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import table
from ._learn import ROWS, char_features, fit_in_a_task, hellinger, logistic, stratified, word_features
from ._text import ids_of, mix64, pieces, words

#: Bound of the training sample, per class; bits of the hashed features.
PER_CLASS, BITS = 1500, 12
#: Probability of low quality from which on a text is dropped.
DROP = 0.5
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(texts: pa.Array) -> np.ndarray:
    return np.concatenate([hellinger(word_features(texts, BITS, range(1, 3))), hellinger(char_features(texts, BITS, range(1, 4)))], axis=1) / np.float32(np.sqrt(2))


def train(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="quality", per_class: int = PER_CLASS):
    """(weights, slope, offset) of the probability of label 0, or None."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.col(label).cast("int")).alias("label"))
    seen = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    if len(seen) < 2:
        return None
    # The sample is drawn from the labels and bounded, so it is broadcast: no text is shuffled.
    drawn = F.broadcast(stratified(usable, "label", "key", per_class))
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(drawn, "key")

    def fit(x: np.ndarray, labels: list, h: np.ndarray):
        y = (np.array(labels) == 0).astype(np.float32)
        if len({*y}) < 2:
            return None
        fold = mix64(h.view(np.uint64)) % np.uint64(5) == 0
        if len({*y[fold]}) < 2 or len({*y[~fold]}) < 2:
            fold = np.ones(len(y), bool)
        learn = ~fold if not fold.all() else fold
        balance = np.where(y[learn] == 1, 1 / max(y[learn].sum(), 1), 1 / max((1 - y[learn]).sum(), 1))
        w = logistic(x[learn], y[learn, None], balance, l2=1e-5, steps=300)
        z = (x[fold] @ w[:-1] + w[-1])[:, 0]
        # Platt's calibration on the other fold, each class with its share in the corpus.
        share = np.where(y[fold] == 1, seen[0] / max(y[fold].sum(), 1), seen[1] / max((1 - y[fold]).sum(), 1))
        return w[:, 0], *_platt(z.astype(float), y[fold], share)

    return fit_in_a_task(sample.select("key", "text", "label"), lambda b: features(b.column("text")), fit)


def _platt(z: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through weighted scores: Newton's
    method, each step halved until the loss falls, targets smoothed as Platt does."""
    share = share / share.sum() * len(z)
    pos, neg = share[y == 1].sum(), share[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    loss = lambda w: float((share * (np.logaddexp(0, x @ w) - t * (x @ w))).sum())
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - t))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, now, part = np.linalg.solve(h, g), loss(w), 1.0
        while part > 1e-8 and loss(w - part * step) > now - 1e-4 * part * float(g @ step):
            part /= 2
        if part <= 1e-8:
            break
        w = w - part * step
        if abs(part * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def low_quality(model, texts: pa.Array) -> np.ndarray:
    """Calibrated probability of low quality."""
    w, a, b = model
    out = np.empty(len(texts))
    for s in range(0, len(texts), ROWS):
        out[s : s + ROWS] = features(texts.slice(s, ROWS)) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(a * out + b, -50, 50)))


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base statistics of each text."""
    # take() copies: some Arrow kernels go wrong on the offset of a slice.
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    flat, bounds = words(texts)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    chars = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    ids, _ = ids_of(flat)
    return {
        "n_words": n,
        "word_chars": np.bincount(doc, chars, len(n)).astype(np.int64),
        "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": _repeated_lines(texts),
        "n_repeat_words": _repeated_words(ids, doc, len(n)),
    }


def _repeated_words(ids: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Words in runs of WINDOW = 8 words that a text holds twice or more."""
    run, reach = ids, 1
    while reach < WINDOW and len(run) > reach:
        run = np.unique(run[:-reach] * (run.max() + 1) + run[reach:], return_inverse=True)[1]
        reach *= 2
    if len(ids) < WINDOW:
        return np.zeros(texts, np.int64)
    at = np.flatnonzero(doc[: len(run)] == doc[WINDOW - 1 :])
    key = doc[at] * (run.max() + 1) + run[at]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + WINDOW, -1)
    return np.bincount(doc, np.cumsum(mark)[:-1] > 0, texts).astype(np.int64)


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    ids, _ = ids_of(lines)
    key = doc[real] * (len(lines) + 1) + ids[real]
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return np.bincount(doc[real], ~first, len(texts)).astype(np.int64)


def judge(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", drop: float = DROP) -> DataFrame:
    """(id_col, the base statistics, base_failed, p_low, kept) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = piece.column("text")
            s = statistics(texts)
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
            p = np.zeros(len(texts)) if model is None else low_quality(model, texts)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), *[pa.array(s[k], pa.int64()) for k in _STATS], pa.array(failed), pa.array(p), pa.array(~failed & (p < drop))],
                ["id", *_STATS, "base_failed", "p_low", "kept"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{k} long' for k in _STATS)}, base_failed boolean, p_low double, kept boolean").withColumnRenamed("id", id_col)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judge(docs, model)


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE: dict = {}
