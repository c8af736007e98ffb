"""Hashed n-gram features of text batches, and linear classifiers on them.

Features are worked out where the texts are; only sparse vectors of bounded size
travel to the one task that fits a model, so the sample's bytes are bounded
whatever the texts' lengths (at most ``6 * 2^bits`` a block and row), and neither
the driver nor an executor holds more than the sample. Its bound in rows is a
parameter of each operator. A key counts once in a sample, and rows are sorted
inside the task, so that a model depends neither on repeats of a row nor on the
order in which blocks arrive. A lost executor only means that the task runs again.

A text of any length is hashed in blocks of ``POINTS`` code points: besides the
text itself (8 bytes a code point while it is folded), memory doesn't grow with it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import ids_of, pieces, rolling, words, xxh64

#: Texts whose dense features are held at once; code points hashed at once.
ROWS, POINTS = 256, 1 << 20
#: Classes of a label at most: the most frequent ones are learned.
CLASSES = 256


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the lower-cased texts, and the bounds of each."""
    low = [(t or "").lower() for t in texts.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def _histogram(out: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> None:
    width = out.shape[1]
    out += np.bincount(doc * width + bucket, minlength=out.size).reshape(out.shape)


def char_features(texts: pa.Array, bits: int, orders: range) -> np.ndarray:
    """(texts, 2^bits) counts of hashed character n-grams of whole texts."""
    every, bounds = code_points(texts)
    out = np.zeros((len(texts), 1 << bits))
    reach = orders[-1] - 1
    for lo in range(0, len(every), POINTS):
        points = every[lo : lo + POINTS + reach]  # n-grams that begin in the block may end after it
        doc = np.searchsorted(bounds, np.arange(lo, lo + len(points)), side="right") - 1
        h = np.zeros(len(points), np.uint32)
        for n in range(1, orders[-1] + 1):
            if len(points) < n:
                break
            # h[i]: hash of the n code points from i on
            h = h[: len(points) - n + 1] * np.uint32(0x01000193) + (points[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            if n in orders:
                own = h[:POINTS]
                whole = doc[: len(own)] == doc[n - 1 : n - 1 + len(own)]
                _histogram(out, doc[: len(own)][whole], (((own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))[whole].astype(np.int64))
    return out


def word_features(texts: pa.Array, bits: int, orders: range) -> np.ndarray:
    """(texts, 2^bits) counts of hashed word n-grams."""
    flat, bounds = words(texts, lower=True)
    out = np.zeros((len(texts), 1 << bits))
    ids, distinct = ids_of(flat)
    h1 = xxh64(distinct)[ids] if len(ids) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for n in orders:
        h = rolling(h1, n)
        if len(h):
            whole = doc[: len(h)] == doc[n - 1 :]
            _histogram(out, doc[: len(h)][whole], (h >> np.uint64(64 - bits))[whole].astype(np.int64))
    return out


def hellinger(counts: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies: rows of length 1 (or 0)."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (features + 1, tasks) of logistic regressions for labels y in
    {0, 1} (rows, tasks); the last row is the bias. Nesterov's method."""
    n, d = x.shape
    share = np.full((n, 1), 1 / n, np.float32) if weight is None else (weight / weight.sum()).astype(np.float32)[:, None]
    w = np.zeros((d + 1, y.shape[1]), np.float32)
    v, rate = w.copy(), np.float32(4 / (1.1 + 4 * l2))  # rows have length sqrt(2) at most, bias included
    rate = rate / np.float32(2)
    for k in range(steps):
        z = x @ v[:-1] + v[-1]
        g = share * (1 / (1 + np.exp(-z)) - y)
        new = v - rate * np.concatenate([x.T @ g + np.float32(l2) * v[:-1], g.sum(axis=0, keepdims=True)])
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def _pack(x: np.ndarray) -> bytes:
    """A row of features: its places (16 bits each), then its values."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].astype(np.float32).tobytes()


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        n = len(r) // 6
        out[i, np.frombuffer(r, np.uint16, n)] = np.frombuffer(r, np.float32, n, 2 * n)
    return out


def fit_in_a_task(sample: DataFrame, features: Callable[[pa.RecordBatch], np.ndarray], fit: Callable[[np.ndarray, list, np.ndarray], object]) -> object:
    """``fit(x, labels, h)`` over the bounded ``sample`` (key, text, label, and what
    else ``features`` look at), in one task; what it returns (a model of fixed size)
    comes back to the driver. ``x`` are features of at most 2^16 places; ``h`` is a
    hash of key and text by which rows are sorted and may be dealt into folds."""
    kinds = {f.name: f.dataType.simpleString() for f in sample.schema}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            for s in range(0, piece.num_rows, ROWS):
                part = piece.slice(s, ROWS)
                x = features(part)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("h"), part.column("label"), pa.array([_pack(r) for r in x], pa.binary()), pa.array([x.shape[1]] * len(x), pa.int32())], ["key", "h", "label", "x", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("h", "ascending"), ("label", "ascending"), ("x", "ascending")])
        x = unpack(t.column("x").to_pylist(), t.column("width")[0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, t.column("label").to_pylist(), t.column("h").to_numpy()))], pa.binary())], ["model"])

    hashed = sample.withColumn("h", F.xxhash64("key", "text"))
    rows = hashed.mapInArrow(vectors, f"key {kinds['key']}, h long, label {kinds['label']}, x binary, width int")
    one = rows.groupBy("key").agg(F.min(F.struct("h", "label", "x", "width")).alias("r"))
    models = one.select("r.*").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(models[0][0])) if models else None


def hash_unit(key: Column, salt: str = "sample") -> Column:
    """Uniform in [0, 1) by a hash of the key."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def stratified(labelled: DataFrame, label: str, key: str, per_class: int, total: int = 6400) -> DataFrame:
    """The rows of about ``per_class`` keys of each class, and of ``total`` in
    all, or all if there are fewer, drawn by a hash of ``key``; reruns agree. Of
    over CLASSES labels the most frequent count, ties by value. One narrow pass
    counts the classes."""
    counts = labelled.groupBy(label).agg(F.approx_count_distinct(key, 0.02).alias("__n"))
    rates = {r[0]: r[1] for r in counts.orderBy(F.desc("__n"), label).limit(CLASSES).collect()}
    if not rates:
        return labelled
    per_class = max(1, min(per_class, total // len(rates)))
    rate = F.element_at(F.create_map(*[F.lit(x) for c, n in rates.items() for x in (c, min(1.0, per_class / max(n, 1)))]), F.col(label))
    return labelled.where(F.col(label).isin(*rates) & (hash_unit(F.col(key)) < rate))
