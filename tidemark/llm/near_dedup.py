"""SimHash near-duplicates by a binary-trie self-join.

1. Every text gets its fingerprint(s), in Arrow batches; equal fingerprints
   become one node, so copies cost nothing further.
2. Fingerprints within ``radius`` bits agree on one of radius + 1 blocks of
   bits, so each is sent to one group per block. A group of over ``group``
   fingerprints is parted again by blocks of its remaining bits, which loses no
   pair; with at most FREE bits left a group is small by itself.
3. Within a group the fingerprints form a binary trie, joined with itself: node
   pairs are traversed together level by level, differing bits accumulate, and a
   pair is pruned once the budget is exceeded. Of the links found, a group hands
   on a spanning forest only, never all pairs.
4. Components of the forests, by alternating stars, are the classes.

Scale: steps 2 to 4 move fingerprints and ids, never texts. Groups of any size
end up in tasks of at most ``GROUP`` rows; nothing is collected. A task holds
FRONTIER pairs of trie nodes and ROWS pairs of rows at once, however many there are.

With ``sketches`` over 1, independent fingerprints link if any one of them does.

``keep_one`` decides by the texts: rows are copies if their sets of five-word
shingles (as 64-bit hashes) have a Jaccard similarity of 0.8 or more, or if such
pairs connect them. Candidates share one of the four blocks of one of 24 sketches of distinct
shingles, and the trie join of a group finds those within 12 bits. Each candidate
is verified. Where a group has few pairs a row they are handed on and verified once,
however many groups found them. In a crowded group (a family of near copies) there
would be pairs without end, so its rows get their sets of shingles instead: the task
verifies all pairs but those that are connected already, and hands on a spanning
forest. The groups of the first sketches go first, each row once in a group, so
that families become classes; in the others only pairs of different classes count.
There a group of over ``group`` rows is cut into tiles: rows of its largest class
meet the others, not each other, so copies of rows grow with the largest class times
the tiles of the others, and with the square of the others alone. Simulated, a lone
pair of similarity 0.8 is a candidate with probability above 0.99 (0.96 where texts
have four or five shingles), of 0.85 with practically 1. Texts equal in all 24
sketches are one node.

Defined results: a null or wordless text has fingerprint zero and links like any
other. Rows with a null id link but lend no id; the component is null if nothing
linked has one. Repeated rows share a component. An empty table gives no rows. ids
keep their type, and the least is by its order. A very long text is read whole, in
blocks of words. Columns of any names pass through ``keep_one`` but ``__id`` and
``__th``; in ``near_dups`` other columns take no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import materialise, table
from ._text import pieces
from .components import components
from .simhash import fingerprints, shingle_sets

RADIUS, GROUP = 3, 2048
#: Bits: a group with no more of them free has 2^FREE fingerprints at most and isn't parted.
FREE = 12
#: Groups are joined together as long as the squares of their sizes sum to this.
PAIRS = 1 << 22
#: The same for candidates, of which the wide radius prunes few; and the rows, and pairs of rows, taken at once.
CANDIDATES, ROWS = 1 << 18, 1 << 15
#: Of crowded groups: shingles held at once, pairs verified at once, shingles to a
#: plane of bits, and bits that are kept from one lot of pairs to the next.
SHINGLES, LOT, PLANE, KEPT_BITS = 1 << 22, 1 << 12, 1 << 13, 1 << 29
#: Pairs of trie nodes held at once.
FRONTIER = 1 << 15
#: Of ``keep_one``: sketches, blocks of each, bits apart in a sketch of candidates, share of
#: bits apart in all sketches beyond which texts can't be similar, and the similarity of copies.
#: At 0.8 about 0.15 of the bits differ, give or take 0.009 (0.19 in texts of a few shingles).
SKETCHES, BLOCKS, NEAR, FAR, SIMILAR = 24, 4, 12, 0.25, 0.8
#: The share that holds between texts of this many shingles or more: five times 0.009 above 0.15.
FAR_OF_LONG, LONG = 0.2, 64
#: A group with more pairs a row than this is crowded. It decides where pairs are verified, not
#: which: a pair that is handed on moves up to two rows' sketches and sets, a crowded row one set.
MANY = 2
#: Sketches whose groups go first; the others' groups skip what these connect.
EARLY = 4
#: So many shingles of a text weigh as much as a row when groups are cut into tiles.
WEIGHT = 4096


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, sketches: int) -> DataFrame:
    """(id, fp array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            fp = fingerprints(piece.column("text"), shingle, sketches).view(np.int64)
            offsets = pa.array(np.arange(len(fp) + 1, dtype=np.int32) * sketches)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.ListArray.from_arrays(offsets, pa.array(fp.ravel()))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp array<long>")


def _part(rows: DataFrame, bits: str, rest: str, blocks: int, key) -> DataFrame:
    """Each row once per block: (key, bits left, rest of bits, fp, node). The
    ``bits`` low bits of ``rest`` are rotated to bring the block to the top."""
    at = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    start, end = F.expr(f"j * {bits} div {blocks}").cast("int"), F.expr(f"(j + 1) * {bits} div {blocks}").cast("int")
    at = at.withColumns({"lo": start, "w": end - start})
    low = f"CASE WHEN {bits} >= 64 THEN -1L ELSE shiftleft(1L, {bits}) - 1L END"
    turned = F.expr(f"CASE WHEN lo = 0 THEN {rest} ELSE (shiftleft({rest}, lo) | shiftrightunsigned({rest}, {bits} - lo)) & ({low}) END")
    at = at.withColumn("turned", turned)
    value = F.expr(f"shiftrightunsigned(turned, {bits} - w)")
    left = F.expr(f"CAST({bits} - w AS INT)")
    return at.select(key(F.col("j"), value).alias("key"), left.alias("bits"), F.expr(f"turned & (shiftleft(1L, {bits} - w) - 1L)").alias("rest"), "fp", "node")


def route(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(key, fp, node) of groups of at most ``group`` rows (or of FREE free bits)
    such that any two fingerprints of a sketch within ``radius`` meet in one."""
    first = nodes.select("sketch", F.lit(64).alias("b"), F.col("fp").alias("r"), "fp", "node")
    whole = _part(first, "b", "r", radius + 1, lambda j, v: F.xxhash64(F.col("sketch"), j, v))
    parts = []
    while True:
        whole = materialise(whole, "routes")
        full = whole.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("b")).where((F.col("n") > group) & (F.col("b") > FREE)).select("key")
        full = materialise(full, "full-groups")
        if full.isEmpty():
            parts.append(whole.select("key", "fp", "node"))
            break
        parts.append(whole.join(full, "key", "left_anti").select("key", "fp", "node"))
        again = whole.join(full, "key", "left_semi").select("key", F.col("bits").alias("b"), F.col("rest").alias("r"), "fp", "node")
        whole = _part(again, "b", "r", radius + 1, lambda j, v: F.xxhash64(F.col("key"), j, v))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trie_blocks(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), in blocks, of all pairs within ``radius`` bits inside the
    ranges [lo, hi) of ``fp``; the ranges follow one another, each sorted and
    without repeats. A trie node is a range of one prefix; the frontier holds node
    pairs and their distance. One of over FRONTIER pairs is halved and the halves
    are worked through in turn, so memory doesn't grow with the pairs."""
    if not len(lo):
        return
    origin = int(lo[0])
    fp = fp[origin : int(hi[-1])]
    lo, hi = (lo - origin).astype(np.int32), (hi - origin).astype(np.int32)
    ones: dict[int, np.ndarray] = {}
    todo = [(63, (lo, hi, lo, hi, np.zeros(len(lo), np.int8)))]
    while todo:
        bit, f = todo.pop()
        half = len(f[0]) // 2
        if len(f[0]) > FRONTIER:
            todo += [(bit, tuple(x[half:] for x in f)), (bit, tuple(x[:half] for x in f))]
            continue
        al, ah, bl, bh, d = f
        both = (ah - al == 1) & (bh - bl == 1)  # two leaves: compared at once
        if both.any():
            a, b = al[both], bl[both]
            near = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= radius)
            if near.any():
                yield a[near].astype(np.int64) + origin, b[near].astype(np.int64) + origin
            al, ah, bl, bh, d = (x[~both] for x in f)
        if not len(al):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)]).astype(np.int32)
        up = ones[bit]
        am, bm = ah - (up[ah] - up[al]), bh - (up[bh] - up[bl])
        cross = al != bl
        children = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1), tuple(x[cross] for x in (am, ah, bl, bm, d + 1))]
        alive = [(c[0] < c[1]) & (c[2] < c[3]) & (c[4] <= radius) for c in children]
        todo.append((bit - 1, tuple(np.concatenate([c[i][k] for c, k in zip(children, alive, strict=True)]) for i in range(5))))


def trie_pairs(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """``trie_blocks`` in one."""
    blocks = [(np.empty(0, np.int64),) * 2, *trie_blocks(fp, lo, hi, radius)]
    a, b = (np.concatenate(x) for x in zip(*blocks, strict=True))
    return a, b


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position reachable, for each of n positions."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def join_groups(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests (node, node) of the links in each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    first, size = first[size > 1], size[size > 1]
    out_a, out_b = [], []
    work = np.cumsum(size.astype(np.int64) ** 2) // PAIRS
    for w in np.unique(work):
        lo, hi = first[work == w], (first + size)[work == w]
        a, b = trie_pairs(fp, lo, hi, radius)
        if len(a):
            seen, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = forest(len(seen), at[: len(a)], at[len(a) :])
            child = np.flatnonzero(label != np.arange(len(seen)))
            out_a.append(node[seen[child]])
            out_b.append(node[seen[label[child]]])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def links(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect all nodes linked. ``nodes``: (sketch, fp, node), fp distinct in a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)]

        def emit(rows):
            a, b = join_groups(*rows, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node")]
            new[1] = new[1].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if cut:
                yield emit([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield emit(held)

    # Unsigned order of fp, so that a trie node is a range.
    rows = route(nodes, radius, group).repartition("key").sortWithinPartitions("key", F.expr("fp ^ (-9223372036854775808L)"))
    return rows.mapInArrow(run, "a long, b long")


def near_dups(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 3, sketches: int = 1, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(id, fp, component): one row per row of ``docs``; fp is an array of longs."""
    rows = materialise(fingerprint_rows(docs, id_col, text_col, shingle, sketches), "fingerprints")
    # A node is a fingerprint, named by its hash: ids may be null or repeat.
    same = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.xxhash64("fp")), "nodes")
    each = same.select("node", F.posexplode("fp").alias("sketch", "f"))
    nodes = materialise(each.groupBy("sketch", F.col("f").alias("fp")).agg(F.min("node").alias("node")), "sketches")
    edges = links(nodes, radius, group)
    if sketches > 1:
        shared = each.join(nodes.select("sketch", F.col("fp").alias("f"), F.col("node").alias("least")), ["sketch", "f"])
        edges = edges.unionByName(shared.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    found = components(edges)
    classes = same.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("class"))
    named = classes.groupBy("class").agg(F.min("least").alias("component"))
    classes = classes.join(named, "class").select("fp", "component")
    return rows.join(classes, "fp").select("id", "fp", "component")


def _sketches(docs: DataFrame, shingle: int, sketches: int) -> DataFrame:
    """(id, th, fp array<long>, shingles) of (id, th, text), of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets = shingle_sets(piece.column("text"), shingle)
            fp = fingerprints(piece.column("text"), shingle, sketches, sets=sets).view(np.int64)
            offsets = pa.array(np.arange(len(fp) + 1, dtype=np.int32) * sketches)
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("th"), pa.ListArray.from_arrays(offsets, pa.array(fp.ravel())), pa.array(np.bincount(sets[0], minlength=len(fp)))], ["id", "th", "fp", "shingles"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, th long, fp array<long>, shingles long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles array<long>) of (node, text): sorted hashes of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            doc, h = shingle_sets(piece.column("text"), shingle)
            offsets = np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _meet(nodes: DataFrame, *more: str) -> DataFrame:
    """(key, fp, node, sketch, ...), once per sketch and block: fingerprints with equal
    blocks meet under one key."""
    each = nodes.select("node", *more, F.posexplode("fp").alias("sketch", "fp"))
    each = each.withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(BLOCKS)])))
    value = F.expr(f"shiftrightunsigned(fp, j * {64 // BLOCKS}) & {(1 << 64 // BLOCKS) - 1}L")
    return each.select(F.xxhash64("sketch", "j", value).alias("key"), "fp", "node", "sketch", *more)


def full_groups(nodes: DataFrame, group: int) -> DataFrame:
    """(key, t): keys of more than about ``group`` rows, a long text counting as
    several, by a sample where there are many; and the number of tiles to cut them
    into. This deals out work only."""
    one_in = max(1, min(16, group // 128))
    some = _meet(nodes.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0), "shingles")
    n = some.groupBy("key").agg((F.sum(1 + F.floor(F.col("shingles") / WEIGHT)) * one_in).alias("n"))
    return materialise(n.where(F.col("n") > group).select("key", F.ceil(F.col("n") / (group / 2)).cast("int").alias("t")), "full-groups")


def tiles(nodes: DataFrame, full: DataFrame) -> DataFrame:
    """(key, fp, node) of the first sketches, each full group cut into tiles: no
    key gets many rows and no row is copied, but rows of two tiles don't meet."""
    rows = _meet(nodes).where(F.col("sketch") < EARLY).join(full, "key", "left")
    own = F.expr("CASE WHEN t IS NULL THEN key ELSE xxhash64(key, pmod(xxhash64(key, node), t)) END")
    return rows.select(own.alias("key"), "fp", "node")


def class_shares(nodes: DataFrame, full: DataFrame, group: int) -> DataFrame:
    """(key, main, tm, tr) of full groups of ``nodes`` with classes: the class of most
    rows and the number of tiles to cut its rows and the others into (0 without others)."""
    rows = _meet(nodes, "class", "shingles").join(full, "key")
    n = rows.groupBy("key", "class").agg(F.sum(1 + F.floor(F.col("shingles") / WEIGHT)).alias("n"))
    per = n.groupBy("key").agg(F.max(F.struct("n", "class")).alias("most"), F.sum("n").alias("n"))
    of = lambda c: F.ceil(c / (group / 2)).cast("int")
    return materialise(per.select("key", F.col("most.class").alias("main"), of(F.col("most.n")).alias("tm"), of(F.col("n") - F.col("most.n")).alias("tr")), "class-shares")


def class_tiles(nodes: DataFrame, shares: DataFrame) -> DataFrame:
    """(key, fp, node, class) such that any two rows of a group of the later sketches,
    or of a full group of any, meet unless their class is the same: each tile of the
    main class has a key with each of the others, and these with one another."""
    rows = _meet(nodes, "class").join(shares, "key", "left").where((F.col("main").isNull() & (F.col("sketch") >= EARLY)) | (F.col("tr") > 0))
    rows = rows.withColumn("own", F.expr("pmod(xxhash64(key, node), CASE WHEN class = main THEN tm ELSE tr END)"))
    keys = F.expr("""CASE WHEN main IS NULL THEN array(key)
        WHEN class = main THEN transform(sequence(0, tr - 1), x -> xxhash64(key, 'main', own, CAST(x AS BIGINT)))
        ELSE concat(transform(sequence(0, tm - 1), x -> xxhash64(key, 'main', CAST(x AS BIGINT), own)),
            transform(sequence(0, tr - 1), x -> xxhash64(key, 'others', least(own, x), greatest(own, x)))) END""")
    return rows.select(F.explode(keys).alias("key"), "fp", "node", "class")


def _row_pairs(a: np.ndarray, b: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y), x before y, of pairs (a, b) of runs of ``n`` rows from ``start``,
    all with all, ROWS at a time."""
    m = n[a] * n[b]
    ends = np.cumsum(m)
    for s in range(0, int(ends[-1]), ROWS):
        at = np.arange(s, min(s + ROWS, int(ends[-1])))
        pair = np.searchsorted(ends, at, side="right")
        at -= (ends - m)[pair]
        x, y = start[a[pair]] + at // n[b[pair]], start[b[pair]] + at % n[b[pair]]
        told = (a != b)[pair] | (x < y)
        yield np.minimum(x[told], y[told]), np.maximum(x[told], y[told])


def _runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows in order of key and fp: the start and size of each run of equal
    rows, and of each key with two rows or more the first run, the last and the rows."""
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]))
    n = np.diff(np.concatenate([start, [len(key)]]))
    k = key[start]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    last = np.concatenate([first[1:], [len(k)]])
    rows = np.add.reduceat(n, first)
    return start, n, first[rows > 1], last[rows > 1], rows[rows > 1]


def _near_rows(fp: np.ndarray, start: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (x, y) within ``radius`` bits, in blocks, in the ranges [lo, hi) of runs."""
    equal = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)])
    equal = equal[n[equal] > 1]
    for a, b in itertools.chain(trie_blocks(fp[start], lo, hi, radius), [(equal, equal)] if len(equal) else []):
        yield from _row_pairs(a, b, start, n)


def group_pairs(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int, of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b), all nodes within ``radius`` bits in a run of equal keys, but of groups
    with over MANY pairs a row the keys alone. With classes ``of`` the rows, pairs of
    one class are none."""
    if of is not None and len(key):
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.repeat(np.minimum.reduceat(of, at) != np.maximum.reduceat(of, at), np.diff([*at, len(key)]))
        key, fp, node, of = key[several], fp[several], node[several], of[several]
    if not len(key):
        return
    start, n, first, last, rows = _runs(key, fp)
    work = np.cumsum(rows.astype(np.int64) ** 2) // CANDIDATES
    for w in np.unique(work):
        lo, hi, size = first[work == w], last[work == w], rows[work == w]
        pairs, held = np.zeros(len(lo), np.int64), [(np.empty(0, np.int64),) * 3]
        for x, y in _near_rows(fp, start, n, lo, hi, radius):
            if of is not None:
                open_ = of[x] != of[y]
                x, y = x[open_], y[open_]
            group = np.searchsorted(start[lo], x, side="right") - 1
            pairs += np.bincount(group, minlength=len(lo))
            few = pairs[group] <= MANY * size[group]
            held.append((x[few], y[few], group[few]))
        x, y, group = (np.concatenate(z) for z in zip(*held, strict=True))
        many = pairs > MANY * size
        few = ~many[group]
        yield node[x[few]], node[y[few]], key[start[lo]][many]


def _planes(flat: np.ndarray, row: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Bits (n rows, PLANE values) of the values that several rows hold, all of
    them in turn. ``flat`` are the values of the rows, without repeats in a row."""
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[at]
    row, column = row[shared[at]], column[shared[at]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), PLANE):
        s, e = np.searchsorted(column, [lo, lo + PLANE])
        bits = np.zeros((n, PLANE), bool)
        bits[row[s:e], column[s:e] - lo] = True
        yield np.packbits(bits, axis=1).view(np.uint64)


def crowd_forest(fp: np.ndarray, node: np.ndarray, flat: np.ndarray, bounds: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (node, least node) of the rows of one group within ``radius``
    bits whose sets, flat[bounds[i]:bounds[i + 1]], are as similar as that. Rows of
    one node are connected. Pairs that are connected by then aren't verified."""
    start, n, lo, hi, _ = _runs(np.zeros(len(fp), np.int64), fp)
    names, of = np.unique(node, return_inverse=True)
    label, size = np.arange(len(names)), np.diff(bounds)  # label: least position in names
    row = np.repeat(np.arange(len(fp)), size)
    few = len(fp) * len(flat) <= KEPT_BITS
    planes = None
    for x, y in _near_rows(fp, start, n, lo, hi, radius) if len(lo) else ():
        fit = np.minimum(size[x], size[y]) / np.maximum(np.maximum(size[x], size[y]), 1) >= similarity
        x, y = x[fit], y[fit]
        while len(x):
            open_ = label[of[x]] != label[of[y]]
            x, y = x[open_], y[open_]
            p, q, x, y = x[:LOT], y[:LOT], x[LOT:], y[LOT:]
            if planes is None and few:
                planes = list(_planes(flat, row, len(fp)))
            both = np.zeros(len(p), np.int64)
            for bits in planes if few else _planes(flat, row, len(fp)):
                both += np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64)
            alike = both / np.maximum(size[p] + size[q] - both, 1) >= similarity
            if alike.any():
                label = forest(len(names), np.concatenate([np.arange(len(names)), of[p[alike]]]), np.concatenate([label, of[q[alike]]]))
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def _whole_groups(batches: Iterator[pa.RecordBatch], full) -> Iterator[pa.Table]:
    """The rows in parts that end with a group, each as soon as it is ``full``."""
    parts = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        if not full(parts):
            continue
        held = pa.Table.from_batches(parts).combine_chunks()
        key = held["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if cut:
            yield held.slice(0, cut)
        parts = held.slice(cut).to_batches()
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _by_key(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns).repartition("key").sortWithinPartitions("key", F.expr("fp ^ (-9223372036854775808L)"))


def candidates(rows: DataFrame, radius: int = NEAR) -> DataFrame:
    """(a, b, key): ``group_pairs`` of the groups; the key alone of a crowded one.
    ``rows``: (key, fp, node), and class where pairs of one class are none."""
    columns = ["key", "fp", "node", *(c for c in rows.columns if c == "class")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, lambda parts: sum(p.num_rows for p in parts) >= ROWS):
            key, fp, node, *of = (held[c].to_numpy() for c in columns)
            for a, b, crowded in group_pairs(key, fp.view(np.uint64), node, radius, *of):
                none = pa.nulls(len(crowded), pa.int64())
                a, b = (pa.concat_arrays([pa.array(x), none]) for x in (np.minimum(a, b), np.maximum(a, b)))
                yield pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.nulls(len(a) - len(crowded), pa.int64()), pa.array(crowded)])], ["a", "b", "key"])

    return _by_key(rows, *columns).mapInArrow(run, "a long, b long, key long")


def crowd_links(rows: DataFrame, similarity: float, radius: int = NEAR) -> DataFrame:
    """(a, b): ``crowd_forest`` of each group of ``rows`` (key, fp, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(parts):
            return sum(p.num_rows for p in parts) >= ROWS or sum(len(p.column("shingles").flatten()) for p in parts) >= SHINGLES

        for held in _whole_groups(batches, full):
            key, fp, node = (held[c].to_numpy() for c in ("key", "fp", "node"))
            lists = pa.concat_arrays(held["shingles"].chunks)
            flat, bounds = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e in zip(start, [*start[1:], len(key)], strict=True):
                x, y = crowd_forest(fp[s:e].view(np.uint64), node[s:e], flat[bounds[s] : bounds[e]], bounds[s : e + 1] - bounds[s], radius, similarity)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return _by_key(rows, "key", "fp", "node", "shingles").mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, nodes: DataFrame, sketches: int) -> DataFrame:
    """The pairs (a, b), once each, whose sketches together are near enough for similar texts."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("shingles").alias(f"n_{c}"))
    apart = F.expr(" + ".join(f"bit_count(fp_a[{i}] ^ fp_b[{i}])" for i in range(sketches)))
    far = F.when(F.least("n_a", "n_b") >= LONG, FAR_OF_LONG).otherwise(FAR)
    return pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(apart <= far * 64 * sketches).select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (node, shingles) are as similar as that."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size("s_a").alias("x"), F.size("s_b").alias("y"), F.size(F.array_intersect("s_a", "s_b")).alias("n"))
    return both.where(F.col("n") / (F.col("x") + F.col("y") - F.col("n")) >= similarity).select("a", "b")


def _links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, sets: DataFrame | None, shingle: int, sketches: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) that connect the similar pairs of the groups of ``rows``, as ``candidates``
    takes them; and the sets (node, shingles) known by now, ``sets`` before."""
    told = materialise(candidates(rows), "pairs")
    pairs = materialise(possible(told.where("key IS NULL").select("a", "b"), nodes, sketches), "candidates")
    crowded = materialise(told.where("key IS NOT NULL").select("key").distinct(), "crowded")
    crowds = materialise(rows.join(crowded, "key", "left_semi"), "crowds")
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowds.select("node")).distinct()
    if sets is not None:
        need = need.join(sets.select("node"), "node", "left_anti")
    asked = nodes.join(need, "node").select("node", F.col("least.id").alias("i"), F.col("least.th").alias("t"))
    texts = docs.join(asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("node", "text").dropDuplicates(["node"])
    new = materialise(_sets(texts, shingle), "shingles")
    sets = new if sets is None else sets.unionByName(new)
    name = F.col("class" if "class" in rows.columns else "node")
    crowds = crowds.join(sets, "node").select("key", "fp", name.alias("node"), "shingles")
    return materialise(similar(pairs, sets, similarity).unionByName(crowd_links(crowds, similarity)), "links"), sets


def copies(docs: DataFrame, shingle: int, sketches: int, similarity: float, group: int) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (id, th, text): (id, th, node) of its rows, and (node, id, th)
    with the least row that the node reaches by similar pairs."""
    rows = materialise(_sketches(docs, shingle, sketches).withColumn("node", F.xxhash64("fp")), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least")
    nodes = materialise(rows.groupBy("node", "fp").agg(least, F.min("shingles").alias("shingles")), "nodes")
    full = full_groups(nodes, group)
    early, sets = _links(docs, nodes, tiles(nodes, full), None, shingle, sketches, similarity)
    found = materialise(components(early), "components")
    classed = materialise(nodes.join(found, "node", "left").select(*nodes.columns, F.coalesce("component", "node").alias("class")), "classes")
    late, _ = _links(docs, nodes, class_tiles(classed, class_shares(classed, full, group)), sets, shingle, sketches, similarity)
    if not late.isEmpty():
        found = materialise(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late)), "components")
    classes = nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    heads = classes.groupBy("component").agg(F.min("least").alias("head"))
    return rows.select("id", "th", "node"), classes.join(heads, "component").select("node", F.col("head.id").alias("head_id"), F.col("head.th").alias("head_th"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 5, sketches: int = SKETCHES, similarity: float = SIMILAR, group: int = GROUP) -> DataFrame:
    """``docs`` with one row of each component: of the least id, and of rows that
    repeat an id the least by a hash of the text. A row without an id stays only
    if no row with one is in its component; of rows equal in both one stays, the
    least by a hash of all columns."""
    named = docs.withColumns({"__id": F.col(id_col), "__th": F.xxhash64(text_col)})
    texts = named.select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.col(text_col).alias("text"))
    rows, heads = copies(texts, shingle, sketches, similarity, group)
    told = rows.join(heads, "node").withColumn("kept", F.col("id").eqNullSafe(F.col("head_id")) & (F.col("th") == F.col("head_th")))
    told = materialise(told.groupBy("id", "th", "kept").agg(F.count(F.lit(1)).alias("n")), "told")
    on = lambda x: named["__id"].eqNullSafe(x["id"]) & (named["__th"] == x["th"])
    gone = told.where("NOT kept").select("id", "th")
    again = told.where("kept AND n > 1").select("id", "th")
    if again.isEmpty():
        return named.join(gone, on(gone), "left_anti").select(*docs.columns)
    again = materialise(again, "repeated-rows")
    first = Window.partitionBy("__id", "__th").orderBy(F.col(text_col).asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    one = named.join(again, on(again), "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    drop = gone.unionByName(again)
    return named.join(drop, on(drop), "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
ORACLE: dict = {}
