"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; for each bit a logistic regression over
hashed character n-grams (orders 1 to 3 of the whole lower-cased text) tells
which side of the bit a text is on. Loss-weighted decoding adds up, for each
codeword, the logistic losses of the bits and takes the nearest; where the
runner-up is within ``MARGIN`` the text is flagged as ambiguous. Where even the
nearest codeword is far (a mean loss per bit over ``FAR``; knowing nothing costs
0.69) the text is in none of the learned languages and flagged as foreign, unless
it has fewer than ``LETTERS`` letters, which is too little to say so. Up to six
languages get the exhaustive code; more get the random code, out of many drawn
with a fixed seed, whose least distance between codewords is largest.

Scale: prediction is one map-side pass in Arrow batches, with a model of some
100 kB in the closure (a bit more per language, of which CLASSES are learned at
most). Training takes about ``PER_LANGUAGE`` labelled texts of each language,
drawn by a hash: features where the texts are, the fit in one task.

Defined results: null text, or text without a letter, is ``und`` with score 0 and
foreign; so is everything if there are no labelled rows. With one language only,
that is predicted with score 1, and nothing with a letter is foreign. Repeated rows
are predicted alike; of rows that repeat an id one is trained on, and rows without an id
share one id there. Ties of codewords go to the language first in text order. Texts
of any length are read whole, in blocks of code points. ids keep their type; other
columns don't take part in a prediction, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import table
from ._learn import ROWS, char_features, fit_in_a_task, hellinger, logistic, stratified
from ._text import pieces

#: Bound of the training sample, per language; bits of the hashed features.
PER_LANGUAGE, BITS, ORDERS = 800, 12, range(1, 4)
#: Difference of mean losses per bit below which the runner-up counts as equal.
MARGIN = 0.05
#: Mean loss per bit from which a text is in no learned language; letters that it takes to tell.
FAR, LETTERS = 0.48, 12
UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """(languages, bits) of 0 and 1, without constant or complementary bits."""
    if k <= 6:
        columns = [(1, *c) for c in product((0, 1), repeat=max(k - 1, 0)) if not all(c)]
        return np.array(columns, np.int8).reshape(-1, k).T
    rng = np.random.default_rng(7)
    n = int(np.ceil(10 * np.log2(k)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (k, n), np.int8)
        code = code[:, (code.min(axis=0) == 0) & (code.max(axis=0) == 1)]
        d = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 10 * n * np.eye(k, dtype=int)
        if d.min() > apart:
            best, apart = code, d.min()
    return best


def features(texts: pa.Array) -> np.ndarray:
    return hellinger(char_features(texts, BITS, ORDERS))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE):
    """(languages, codewords, weights), or None without labelled rows."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("label"))

    def fit(x: np.ndarray, labels: list, h: np.ndarray):
        langs = sorted(set(labels))
        code = codewords(len(langs))
        place = {c: i for i, c in enumerate(langs)}
        target = np.array([place[c] for c in labels])
        balance = 1 / np.bincount(target, minlength=len(langs))[target]
        return langs, code, logistic(x, code[target].astype(np.float32), balance, l2=1e-5, steps=300) if code.size else None

    return fit_in_a_task(stratified(usable, "label", "key", per_language), lambda b: features(b.column("text")), fit)


def decode(model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language, score in 0..1, ambiguity and mean loss of each row of features."""
    langs, code, w = model
    if w is None:
        return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool), np.zeros(len(x))
    margin = x @ w[:-1] + w[-1]
    signs = 2.0 * code - 1
    loss = np.logaddexp(0, -margin[:, None, :] * signs[None, :, :]).mean(axis=2)
    order = np.sort(loss, axis=1)
    p = np.exp(-code.shape[1] * (loss - order[:, :1]))
    return loss.argmin(axis=1), p.max(axis=1) / p.sum(axis=1), order[:, 1] - order[:, 0] < MARGIN, order[:, 0]


def _predict(model, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Language, score, ambiguity and foreignness of each text."""
    letters = pc.fill_null(pc.count_substring_regex(texts.cast(pa.large_string()), r"\p{L}"), 0).to_numpy(zero_copy_only=False)
    lang, score, unsure, foreign = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool), np.ones(len(texts), bool)
    at = np.flatnonzero(letters) if model is not None else np.empty(0, np.int64)
    for s in range(0, len(at), ROWS):
        i = at[s : s + ROWS]
        best, score[i], unsure[i], loss = decode(model, features(texts.take(pa.array(i))))
        lang[i] = np.array(model[0], object)[best]
        foreign[i] = (loss > FAR) & (letters[i] >= LETTERS)
    return pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure), pa.array(foreign)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, ambiguous, foreign) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("id"), *_predict(model, piece.column("text"))], ["id", "lang_pred", "score", "ambiguous", "foreign"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean, foreign boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model, text_col: str = "text", languages: Iterable[str] | None = None) -> DataFrame:
    """``docs``, all columns kept, without the rows that the classifier rejects:
    texts without a letter, texts in none of the learned languages, and texts in
    another one than ``languages`` (all by default). Ambiguous texts stay: being
    close to two learned languages is no fault. Without a model nothing can be
    told, and every row stays."""
    if model is None:
        return docs
    wanted = pa.array(sorted(model[0] if languages is None else languages), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            lang, _, _, foreign = _predict(model, piece.column(text_col))
            yield piece.filter(pc.and_(pc.is_in(lang, wanted), pc.invert(foreign)))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column) -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous", "foreign")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE: dict = {}
