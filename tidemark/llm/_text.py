"""Arrow-batch text kernels: words, shingles and hashes of many texts at once.

Batches are cut so that a piece holds about ``PIECE_BYTES`` of text; a single
longer text is a piece of its own and is worked through in blocks of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES, BLOCK = 2 << 20, 100_000


def pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words ([^\\x20\\x09-\\x0D]+) of the texts in order, and the bounds:
    text i has words bounds[i]:bounds[i + 1]. Null is empty."""
    # take() copies: some Arrow kernels go wrong on the offset of a slice.
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), kept[offsets].astype(np.int64)


def ids_of(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense ids of the strings of an array, and the distinct strings."""
    enc = flat.dictionary_encode()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def xxh64(strings: pa.Array, seed: int = 42) -> np.ndarray:
    import xxhash

    f = xxhash.xxh64_intdigest
    return np.fromiter((f(b, seed) for b in strings.cast(pa.large_binary()).to_pylist()), np.uint64, len(strings))


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of each run of n elements of h."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mix64(out)
