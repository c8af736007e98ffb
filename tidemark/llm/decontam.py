"""Benchmark decontamination.

A document is contaminated by an item if some window of it, as many words long
as the item, has a weighted similarity of ``THRESHOLD`` or more with the item.

1. Words are folded and hashed; the hashes of all five-word shingles of whole
   texts are looked up among the items' shingles. A window can only be as similar
   as that to an item if at least ``THRESHOLD`` of its own weight is shingles of
   items, so the other windows needn't be looked at; this skips nothing that could
   match.
2. The item-sized windows left, at every offset, get a 128-bit SimHash of their
   shingles, weighted by length, from running sums.
3. Multi-index Hamming blocks: two fingerprints within ``RADIUS`` = 31 bits
   differ by at most 3 bits in one of 8 blocks of 16, so looking up all values
   within 3 bits of a window's block values finds every item in the radius.
4. Exact verification: weighted Jaccard over the shingle multisets, the weight of
   a shingle being its number of bytes. At similarity 0.8 a window is within
   the radius with probability 0.998, and its neighbours get their chance too.

Scale: items that repeat a text are searched as one. Documents are scanned once
per block of ``ITEMS`` items, map-side only, without any shuffle; each block is
broadcast and bounded by about ``ITEMS`` and ``BLOCK_BYTES`` (more only for a
single item above that). Very common passages cost their windows, and items made
after one template are compared in portions of ``_PAIRS``, so memory is bounded by
a block and the text at hand. Matches, few, meet the items' ids in a join.

Defined results: null and empty texts match nothing; an item of one
to four words is one shingle, all of it, and matches where a document has just
these words in a row; a document shorter than the item is one window. Rows that
repeat an id are judged each by itself, items that repeat an id or a text each
match. ids keep their types. Other columns pass through ``decontaminate``, whatever
their names. Ties of windows go to the first. A very long text is read whole, its
windows in stretches of ``_STEP`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import table
from ._text import ids_of, mix64, pieces, rolling, words, xxh64

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 31
#: Bounds of a block of items that is broadcast at once.
ITEMS, BLOCK_BYTES = 32_768, 16 << 20
_BLOCKS, _NEAR = 8, 3
_MASKS = np.array([sum(1 << b for b in c) for k in range(_NEAR + 1) for c in combinations(range(16), k)], np.uint16)
#: Lookups, and pairs of a window and an item, worked out at once.
_PAIRS = 1 << 20
#: Windows whose bits are worked out at once.
_STEP = 1 << 14


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the texts in words; hash and weight of the run of SHINGLE words
    that starts at each word (runs over a text's end mean nothing)."""
    flat, bounds = words(texts, lower=True)
    ids, distinct = ids_of(flat)
    length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[ids]
    h = rolling(xxh64(distinct)[ids], SHINGLE)
    total = np.concatenate([[0], np.cumsum(length)])
    weight = total[SHINGLE:] - total[:-SHINGLE] if len(ids) >= SHINGLE else np.empty(0, np.int64)
    return bounds, h, weight


def _runs(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts in words; hash of the run of n words from each word."""
    flat, bounds = words(texts, lower=True)
    ids, distinct = ids_of(flat)
    return bounds, rolling(xxh64(distinct)[ids], n)


def _bits(h: np.ndarray) -> np.ndarray:
    pair = np.stack([h, mix64(h + np.uint64(0x9E3779B97F4A7C15))], axis=1).astype(">u8")
    return np.unpackbits(pair.view(np.uint8).reshape(-1, 16), axis=1)


def _signs(h: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(windows, 8) blocks of 16 bits: SimHash of the shingles lo:hi of each window."""
    ones = np.concatenate([np.zeros((1, 128), np.int64), np.cumsum(_bits(h) * weight[:, None], axis=0)])
    total = np.concatenate([[0], np.cumsum(weight)])
    out = np.empty((len(lo), _BLOCKS), np.uint16)
    for s in range(0, len(lo), _STEP):
        a, b = lo[s : s + _STEP], hi[s : s + _STEP]
        out[s : s + _STEP] = np.packbits(2 * (ones[b] - ones[a]) > (total[b] - total[a])[:, None], axis=1).view(">u2")
    return out


class Items:
    """A block of benchmark items, indexed."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = pa.array([t for _, t in rows], pa.large_string())
        bounds, h, weight = _shingles(texts)
        size = np.diff(bounds)
        self.items = [i for i in range(len(rows)) if size[i] >= SHINGLE]
        short = [i for i in range(len(rows)) if 0 < size[i] < SHINGLE]
        self.id = [rows[i][0] for i in self.items + short]
        #: Of the items shorter than a shingle: {words: {hash of all: [item]}}.
        self.short: dict[int, dict[int, list[int]]] = {}
        for n in range(1, SHINGLE):
            runs = _runs(texts, n)[1] if n in size[short] else ()
            for k, i in enumerate(short):
                if size[i] == n:
                    self.short.setdefault(n, {}).setdefault(int(runs[bounds[i]]), []).append(len(self.items) + k)
        self.words = size[self.items]
        spans = [(bounds[i], bounds[i + 1] - SHINGLE + 1) for i in self.items]
        self.bags = [_bag(h[a:b], weight[a:b]) for a, b in spans]
        self.sign = np.concatenate([np.empty((0, _BLOCKS), np.uint16), *[_signs(h[a:b], weight[a:b], np.array([0]), np.array([b - a])) for a, b in spans]])
        # Distinct item lengths of each shingle.
        pairs = sorted({(int(x), int(n)) for (u, _, _), n in zip(self.bags, self.words, strict=True) for x in u})
        self.shingles, first = np.unique(np.array([p[0] for p in pairs], np.uint64), return_index=True)
        self.lengths = np.array([p[1] for p in pairs], np.int64)
        self.first = np.concatenate([first, [len(pairs)]])
        self.seen = np.zeros(1 << 22, bool)  # a first, cheap look: low bits of the hash
        self.seen[(self.shingles & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.tables = []
        for b in range(_BLOCKS):
            order = np.argsort(self.sign[:, b], kind="stable").astype(np.int32)
            self.tables.append((np.searchsorted(self.sign[order, b], np.arange((1 << 16) + 1)).astype(np.int32), order))

    def candidates(self, sign: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) pairs of one length within RADIUS bits, in portions of
        windows; a pair comes once."""
        step = max(1, _PAIRS // max(len(_MASKS), len(self.items)))  # a window meets an item once a block at most
        for lo in range(0, len(sign), step):
            own, size = sign[lo : lo + step], length[lo : lo + step]
            found = []
            for b, (start, item) in enumerate(self.tables):
                value = (own[:, b][:, None] ^ _MASKS[None, :]).astype(np.int64)
                n = start[value + 1] - start[value]
                w, m = np.nonzero(n)
                n, first = n[w, m], start[value[w, m]]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                w, i = np.repeat(w, n), item[at].astype(np.int64)
                same = self.words[i] == size[w]
                w, i = w[same], i[same]
                near = np.bitwise_count(own[w] ^ self.sign[i]).sum(axis=1) <= RADIUS
                found.append(w[near] * np.int64(len(self.items)) + i[near])
            both = np.unique(np.concatenate(found))
            yield lo + both // len(self.items), both % len(self.items)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity): the best window of each pair."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for n, items in self.short.items():
            bounds, h = _runs(texts, n)
            pos = np.flatnonzero(np.isin(h, np.array(list(items), np.uint64)))
            doc = np.searchsorted(bounds, pos, side="right") - 1
            for p, d in zip(pos.tolist(), doc.tolist(), strict=True):
                if p + n <= bounds[d + 1]:
                    for i in items[int(h[p])]:
                        best.setdefault((d, i), (1.0, int(p - bounds[d]), n))
        if self.items:
            self._long(texts, best)
        return [(d, i, a, n, s) for (d, i), (s, a, n) in sorted(best.items())]

    def _long(self, texts: pa.Array, best) -> None:
        bounds, h, weight = _shingles(texts)
        maybe = np.flatnonzero(self.seen[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.shingles, h[maybe]), len(self.shingles) - 1)
        hit = self.shingles[at] == h[maybe]
        pos, which = maybe[hit], at[hit]
        doc = np.searchsorted(bounds, pos, side="right") - 1
        inside = pos + SHINGLE <= bounds[doc + 1]
        pos, which, doc = pos[inside], which[inside], doc[inside]
        for d in np.unique(doc):
            mine = doc == d
            self._document(int(d), int(bounds[d]), int(bounds[d + 1]), pos[mine], which[mine], h, weight, best)

    def _document(self, d, start, end, pos, which, h, weight, best) -> None:
        n = self.first[which + 1] - self.first[which]
        p = np.repeat(pos, n)
        length = self.lengths[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[which], n)]
        total = np.concatenate([[0], np.cumsum(weight[start:end])])
        held = np.zeros(len(total), np.int64)
        held[pos - start + 1] = weight[pos]
        held = np.cumsum(held)
        windows = []
        for size in np.unique(length):
            at = p[length == size]
            if end - start <= size:
                first = np.array([start])
            else:  # every start whose window holds a hit
                mark = np.zeros(end - start + 2, np.int64)
                np.add.at(mark, np.maximum(at - (size - SHINGLE), start) - start, 1)
                np.add.at(mark, np.minimum(at, end - size) - start + 1, -1)
                first = np.flatnonzero(np.cumsum(mark) > 0) + start
            last = np.minimum(first + size, end) - SHINGLE + 1
            # Common weight is at most that of the hits, and at least THRESHOLD of the window's.
            can = held[last - start] - held[first - start] >= (THRESHOLD - 1e-9) * (total[last - start] - total[first - start])
            windows.append(np.stack([first[can], np.full(int(can.sum()), size)], axis=1))
        w = np.concatenate(windows)
        if not len(w):
            return
        lo, size = w[:, 0], w[:, 1]
        hi = np.minimum(lo + size, end) - SHINGLE + 1
        for sel in _stretches(lo, hi):
            a, b = int(lo[sel].min()), int(hi[sel].max())
            sign = _signs(h[a:b], weight[a:b], lo[sel] - a, hi[sel] - a)
            for windows, items in self.candidates(sign, size[sel]):
                bag, of = None, -1
                for x, i in zip(windows.tolist(), items.tolist(), strict=True):
                    y = int(sel[x])
                    if x != of:
                        bag, of = _bag(h[lo[y] : hi[y]], weight[lo[y] : hi[y]]), x
                    s = _similarity(self.bags[i], bag)
                    if s >= THRESHOLD and (-s, int(lo[y]) - start) < self._rank(best.get((d, i))):
                        best[d, i] = (s, int(lo[y]) - start, int(min(size[y], end - lo[y])))

    @staticmethod
    def _rank(known: tuple[float, int, int] | None) -> tuple[float, int]:
        return (0.0, 0) if known is None else (-known[0], known[1])


def _stretches(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """The windows in groups that lie close together: a group covers a stretch
    without gaps, and its windows begin within _STEP words."""
    order = np.argsort(lo, kind="stable")
    start, reach = lo[order], np.maximum.accumulate(hi[order])
    gap = np.cumsum(np.concatenate([[False], start[1:] > reach[:-1]]))
    key = np.stack([gap, (start - start[0]) // _STEP])
    return np.split(order, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1)


def _bag(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, first, n = np.unique(h, return_index=True, return_counts=True)
    return u, n, weight[first]


def _similarity(a, b) -> float:
    """Weighted Jaccard of two shingle multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int((np.minimum(a[1][i], b[1][j]) * a[2][i]).sum())
    return common / (int((a[1] * a[2]).sum()) + int((b[1] * b[2]).sum()) - common)


def item_blocks(items: DataFrame, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Blocks of at most about ITEMS distinct texts, by a hash of the text, and
    BLOCK_BYTES bytes."""
    texts = items.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).distinct()
    rows, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = int(max(-(-rows // ITEMS), -(-size // BLOCK_BYTES), 1))
    for k in range(n):
        yield sorted((r[0], r[1]) for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect())


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """(id_col, item_col, start_word, n_words, similarity) for each document and
    item of which some window reaches THRESHOLD: its best window."""
    found = None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for block in item_blocks(items, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Items(shared.value)
            for piece in pieces(batches, "text"):
                hits = index.search(piece.column("text"))
                ids = piece.column("id").take(pa.array([x[0] for x in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([index.id[x[1]] for x in hits], pa.int64()), *[pa.array([x[k] for x in hits], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]],
                    ["id", "t", "start_word", "n_words", "similarity"],
                )

        part = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t long, start_word long, n_words long, similarity double")
        found = part if found is None else found.unionByName(part)
    names = items.select(F.xxhash64(item_text_col).alias("t"), F.col(item_col).alias("item")).where(F.col(item_text_col).isNotNull())
    return found.join(names, "t").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start_word", "n_words", "similarity")


def decontaminate(docs: DataFrame, items: DataFrame, text_col="text", item_text_col="text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    for block in item_blocks(items, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Items(shared.value)
            for piece in pieces(batches, text_col):
                clean = np.ones(piece.num_rows, bool)
                clean[[x[0] for x in index.search(piece.column(text_col))]] = False
                yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLE: dict = {}
