"""SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._text import BLOCK, mix64, words, xxh64


def _shingles(flat: pa.Array, bounds: np.ndarray, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of the shingles, in order of texts but for those of fewer
    words than a shingle, which have one, all of them, and come last."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    last = len(flat) - shingle + 1
    for lo in range(0, max(last, 0), BLOCK):
        at = np.arange(lo, min(lo + BLOCK, last))
        at = at[doc[at] == doc[at + shingle - 1]]
        if len(at):
            part = pc.binary_join_element_wise(*[flat.take(pa.array(at + k)) for k in range(shingle)], pa.scalar(" ", flat.type))
            yield doc[at], xxh64(part)
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        yield short, xxh64(pa.array([" ".join(flat.slice(bounds[i], n[i]).to_pylist()) for i in short]))


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted and without repeats."""
    parts = list(_shingles(*words(texts, lower=True), shingle))
    doc, h = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.uint64)), *parts, strict=True))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(h)]
    return doc[new], h[new]


def fingerprints(texts: pa.Array, shingle: int = 3, sketches: int = 1, sets: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """(texts, sketches) fingerprints of 64 bits: a bit is set if it is in over
    half of the hashes of the text's shingles, repeats included; of its distinct
    ones if these are given (``shingle_sets``). The first sketch uses XXH64 with seed 42, the others
    mix that hash anew. A text of fewer words has one shingle, all of it; one
    without words has zeros."""
    ones, total = np.zeros((len(texts), sketches, 64), np.int64), np.zeros(len(texts), np.int64)
    if sets is not None:
        every, own = sets
        parts = ((every[lo : lo + BLOCK], own[lo : lo + BLOCK]) for lo in range(0, len(own), BLOCK))
    else:
        parts = _shingles(*words(texts, lower=True), shingle)
    for doc, h in parts:
        _count(ones, doc, h)
        total += np.bincount(doc, minlength=len(texts))
    bits = ones * 2 > total[:, None, None]
    return np.packbits(bits, axis=2).view(">u8").astype(np.uint64)[:, :, 0]


def _count(ones: np.ndarray, doc: np.ndarray, h: np.ndarray) -> None:
    """Adds up the set bits per document. A hash is unpacked to 64 bytes, and runs
    of up to 255 hashes are summed as packed bytes, eight to a machine word."""
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    first = np.flatnonzero(new)
    at = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate([first, [len(h)]])))
    runs = np.flatnonzero(at % 255 == 0)
    head = np.flatnonzero(new[runs])
    for k in range(ones.shape[1]):
        own = mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else h
        bits = np.unpackbits(own.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(bits, runs, axis=0).view(np.uint8).reshape(-1, 64)
        ones[doc[first], k] += np.add.reduceat(sums, head, axis=0, dtype=np.int64)
