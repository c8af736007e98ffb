"""The training-data operators against plain statements of their results, and on
nulls, empty and very long texts, ties, repeated rows, empty tables and columns
with clashing names."""

import random
import sys
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidemark.llm import chat, decontam, language_id, line_dedup, mixing, near_dedup, pii, quality, sharding, url_filter  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "A line that is shared by several documents, more or less"
VOCABULARY = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "Eta", "theta", "iota", "KAPPA", "été", "größe", "日本"]


def prose(seed, n=60, lines=8):
    rng = random.Random(seed)
    out = [f"{rng.choice(VOCABULARY)}{rng.randint(0, 99)}" for _ in range(n)]
    return "".join(w + ("\n" if i % lines == lines - 1 else " ") for i, w in enumerate(out))


@pytest.fixture(scope="module")
def rows():
    """Ordinary, null, empty, blank, repeated and very long texts, and copies."""
    out = [(i, prose(i) + f"\n  {COMMON.upper() if i % 2 else COMMON}\t\n" + prose(i + 1000, 20), "en", f"s{i % 4}", 1) for i in range(24)]
    out += [(30, None, None, None, None), (31, "", "en", None, 0), (32, " \t\n\x0b ", "en", "s1", 5), (33, "\n\n", None, "s9", 2), (None, prose(5), "en", "s1", 3), (None, None, None, None, None)]
    out += [(40, prose(4000) + "\n" + COMMON, "en", "s2", 1)] * 2 + [(41 + i, prose(77), "en", "s2", 1) for i in range(5)]
    out += [(60, " ".join(f"w{i % 5000}" for i in range(60_000)), "en", "s3", 1), (61, "x" * 300_000, "en", "s3", 1), (62, "one", "en", "s3", 1), (63, "one two", "en", "s3", 1)]
    return out


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """The same rows with columns named like those that operators add."""
    return df.selectExpr("*", *[f"'x' AS {c}" for c in ("size", "shard", "slot", "taken", "target", "kept_text", "n_lines", "host", "verdict", "key", "id", "fp", "component", "kind", "start")])


# ------------------------------------------------------------------ line dedup


def test_line_dedup(docs, rows, empty):
    out = line_dedup.dedup_lines(clash(docs))
    assert "component" in out.columns and out.columns.count("n_lines") == 1
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=str)
    assert got == sorted(brute.dedup_lines([r[:2] for r in rows]), key=str)
    assert line_dedup.dedup_lines(empty).collect() == []


def test_line_dedup_counts_documents_not_lines(spark):
    line = "x" * 20
    t = spark.createDataFrame([(1, f"{line}\n{line}\n{line}"), (2, f" {line.upper()} \n{line[:-1]}"), (2, f"{line}\nother")], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(t).collect()} == {0}
    three = t.union(spark.createDataFrame([(9, f"a\n{line}\nb\n{line}")], t.schema))
    assert sorted((r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(three).collect()) == [(1, ""), (2, "other"), (2, line[:-1]), (9, f"a\n{line}\nb\n{line}")]


# --------------------------------------------------------------------- mixing


def test_mixing(docs, rows, empty):
    out = mixing.mix(clash(docs)).collect()
    assert len(out) == len(rows)
    sizes, source = {}, {}
    for r in rows:
        source[r[3]] = source.get(r[3], 0) + len(brute.words(r[1]))
    want = brute.targets(source)
    for r in out:
        assert r["size"] == len(brute.words(r.text)) and r.source_size == source[r.source] and r.target == pytest.approx(want[r.source], abs=1e-5) and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r.taken
    for s in source:
        assert abs(sizes[s] - want[s]) <= 2, s  # one word for the floor, one for a tie at the cut
    assert sorted(map(str, mixing.mix(clash(docs)).collect())) == sorted(map(str, out))
    assert mixing.mix(empty).collect() == [] and mixing.mixed_rows(empty).collect() == []


def test_mixing_targets(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 7, 100, 1000, 10**6]) for s in [None, "", "a", "b", "é", "Z", "z"][: rng.randint(1, 7)]}
        t = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
        got = {r.src: r.target for r in mixing.source_targets(t).collect()}
        assert got == pytest.approx(brute.targets(sizes), abs=1e-5)


def test_mixed_rows(docs):
    plan = {(r.doc_id, r.text): r for r in mixing.mix(docs).collect()}
    out = mixing.mixed_rows(clash(docs))
    assert out.columns == clash(docs).columns and {r["size"] for r in out.collect()} == {"x"}
    assert sum(len(brute.words(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs).collect())
    for r in out.collect():
        if (r.doc_id, r.text) not in plan:  # the copy at a cut is the beginning of its text
            assert any(k[0] == r.doc_id and k[1].startswith(r.text) for k in plan if k[1])


# --------------------------------------------------------------------- quality


def test_quality_statistics(spark, docs, rows, empty):
    extra = ["a b c d e f g h a b c d e f g h i", "a a a a a a a a a a", "l one\nl one\n\n\nl one \n#$", "x " * 7, "w1 w2 w3 w4 w5 w6 w7 w8 x w1 w2 w3 w4 w5 w6 w7 w8"]
    table = clash(docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")))
    text = dict([(r[0], r[1]) for r in rows if r[0] is not None] + [(100 + i, t) for i, t in enumerate(extra)])
    for r in quality.judge(table, None).collect():
        if r.doc_id is not None:
            want = brute.quality(text[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(empty, None).collect() == [] and quality.train(empty, spark.createDataFrame([], "doc_id long, quality int")) is None
    one = spark.createDataFrame([(i, 1) for i in range(20)] + [(99, None)], "doc_id long, quality int")
    assert quality.train(docs, one) is None


def test_quality_model(spark):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["the", "story", "goes", "on", "with", "care", "and", "thought"]) + str(rng.randint(0, 40)) for _ in range(40))) for i in range(150)]
    bad = [(1000 + i, " ".join(rng.choice(["BUY!!", "$$$", "free**", "click%%", "win&&"]) + str(rng.randint(0, 40)) for _ in range(40))) for i in range(80)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = table.select("doc_id", F.when(F.col("doc_id") < 1000, 1).otherwise(0).alias("quality")).where("doc_id % 2 = 0")
    out = quality.judge(table, quality.train(table, labels)).collect()
    held = [(r.kept, r.doc_id < 1000, r.p_low) for r in out if r.doc_id % 2 and not r.base_failed]
    assert held and all(kept == is_good for kept, is_good, _ in held) and all(0 <= p <= 1 for _, _, p in held)


# -------------------------------------------------------------------- SimHash


@pytest.fixture(scope="module")
def near(rows):
    rng = random.Random(5)
    out = [r[:2] for r in rows]
    base = prose(500, 300).split()
    for i in range(60):  # near copies: a word or two changed
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        out.append((500 + i, " ".join(w)))
    return out


def test_near_dups(spark, near, empty):
    table = clash(spark.createDataFrame(near, "doc_id long, text string").repartition(3))
    fp, component = brute.near_components(near)
    want = sorted((str(d), f, str(c)) for (d, _), f, c in zip(near, fp, component, strict=True))
    for group in (2048, 4):  # small groups are parted again and again
        got = near_dedup.near_dups(table, group=group).collect()
        assert sorted((str(r.id), r.fp[0] % 2**64, str(r.component)) for r in got) == want
    assert near_dedup.near_dups(empty).collect() == [] and near_dedup.keep_one(empty).collect() == []


def _noisy_groups():
    """Keys and fingerprints of three groups, one without near pairs, in order."""
    import numpy as np

    rng = np.random.default_rng(5)
    key = np.repeat(np.arange(3), (30, 60, 50))
    noise = (rng.random((140, 64)) < 0.1).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fp = np.where(np.arange(140) < 30, rng.integers(0, 1 << 62, 140).astype(np.uint64), noise)
    fp[35:40] = fp[34]
    return key, fp[np.lexsort((fp, key))]


def test_group_pairs_in_small_blocks(monkeypatch):
    """Frontiers and pairs cut small: all pairs of a group, or the key of a crowded one."""
    import numpy as np

    key, fp = _noisy_groups()
    node = np.arange(140) + 7
    want = {(i, j) for i in range(140) for j in range(i) if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= 12}
    monkeypatch.setattr(near_dedup, "FRONTIER", 4)
    monkeypatch.setattr(near_dedup, "ROWS", 8)
    for many in (1000, 0, 15):
        monkeypatch.setattr(near_dedup, "MANY", many)
        got, crowded = [], set()
        for a, b, k in near_dedup.group_pairs(key, fp, node, 12):
            got += [(int(max(x, y)) - 7, int(min(x, y)) - 7) for x, y in zip(a, b, strict=True)]
            crowded |= set(k.tolist())
        assert crowded == {g for g in range(3) if sum(key[i] == g for i, _ in want) > many * (key == g).sum()}
        assert sorted(got) == sorted(p for p in want if key[p[0]] not in crowded)
    assert crowded and got  # the last bound parts the groups


def test_crowd_forest(monkeypatch):
    """The classes of all pairs within the radius and similar enough, in whatever lots and planes."""
    import numpy as np

    key, fp = _noisy_groups()
    fp = fp[key == 1]
    rng = random.Random(6)
    sets = [sorted({rng.randrange(40) if rng.random() < 0.06 else 1000 * (i % 3) + k for k in range(rng.randint(18, 30))}) for i in range(58)] + [[5], []]
    flat, bounds = np.array([v for x in sets for v in x]), np.cumsum([0, *map(len, sets)])
    label, links = list(range(60)), 0
    for i in range(60):
        for j in range(i):
            both, either = len(set(sets[i]) & set(sets[j])), len(set(sets[i]) | set(sets[j]))
            if int(fp[i] ^ fp[j]).bit_count() <= 12 and both >= 0.8 * either:
                links += 1
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert links > 60 - len(set(label)) > 0 and len(set(label)) > 4
    for lot, plane, kept in ((1 << 12, 1 << 13, 1 << 29), (3, 64, 1 << 29), (7, 64, 0)):
        monkeypatch.setattr(near_dedup, "LOT", lot)
        monkeypatch.setattr(near_dedup, "PLANE", plane)
        monkeypatch.setattr(near_dedup, "KEPT_BITS", kept)
        a, b = near_dedup.crowd_forest(fp, np.arange(60) + 7, flat, bounds, 12, 0.8)
        assert len(a) == 60 - len(set(label))
        assert near_dedup.forest(60, a - 7, b - 7).tolist() == label
        a, b = near_dedup.crowd_forest(fp, np.array(label) + 7, flat, bounds, 12, 0.8)  # all known
        assert not len(a) and not len(b)


def test_trie_finds_all_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 5, np.uint64)
    fp = np.unique(np.concatenate([rng.integers(0, 2**63, 500, np.uint64)] + [c ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) for c in centre]))
    cut = len(fp) // 3
    for radius in (0, 1, 3, 5):
        a, b = near_dedup.trie_pairs(fp, np.array([0, cut]), np.array([cut, len(fp)]), radius)
        got = {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for lo, hi in ((0, cut), (cut, len(fp))) for i in range(lo, hi) for j in range(i + 1, hi) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
        assert got == want and len(a) == len(got)


def test_keep_one(spark, near, docs):
    table = spark.createDataFrame(near, "doc_id long, text string")
    kept = near_dedup.keep_one(clash(table))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == clash(table).columns and len([i for i in ids if i and i >= 500]) == 1 and 500 in ids
    assert ids.count(40) == 1 and ids.count(41) == 1 and not {42, 43, 44, 45} & set(ids)
    assert {0, 1, 2, 4, 60, 61}.issubset(ids)  # no others like them
    assert ids.count(None) == 1 and ids.count(30) == 1 and 31 not in ids  # without words they are copies


def test_components(spark):
    from tidemark.llm.components import components

    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(300, 340)]
    noise = [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star + noise, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [7, *range(300, 340)]} == {7} and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ------------------------------------------------------------------------ PII


TRICKY = [
    "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111111", "+1 (974) 555-3436 +123 +1 234 567 8901 2345 67 ++49 30 123456-",
    "é@é.com 😀 a@b.co 1.1.1.1 😀+4930123456", "a@b.c@d.e", "@a.b a@.b a@b..c a.@b.c-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", None, "9" * 50_000, "a" * 50_000, "a@" * 2000, "1.1.1.1 " * 300, "+1" * 3000,
]


def test_pii_base(spark, empty):
    table = clash(spark.createDataFrame(list(enumerate(TRICKY)) + [(1, TRICKY[2]), (None, "a@b.c")], "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.b, r.s) for r in pii.find(table).select("doc_id", pii.digest(F.col("base")).alias("b"), pii.digest(F.col("spans")).alias("s")).collect())
    want = sorted((str(i), brute.pii(t), brute.pii(t)) for i, t in [*enumerate(TRICKY), (1, TRICKY[2]), (None, "a@b.c")])
    assert got == want and pii.find(empty).collect() == []


def test_pii_patterns(spark):
    seeds = [(i, f"please call me at +1 (974) 555-{1000 + i} soon") for i in range(8)]
    more = [(100, "😀 please call me at 555-7788-99, soon"), (101, "about 12345 things were"), (102, "call me at home")] + [(200 + i, f"year {1000 + i} was good") for i in range(20)]
    weak = [(300 + i, f"see item {10**15 + i} here") for i in range(30)] + [(400 + i, f"see item +49 30 12345{i}") for i in range(5)]
    got = {r.doc_id: r.s for r in pii.find(spark.createDataFrame(seeds + more + weak, "doc_id long, text string")).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    assert got[100] == "phone:20:31" and got[101] == "" and got[102] == "" and {got[200 + i] for i in range(20)} == {""}
    assert all(got[300 + i] == brute.pii(dict(weak)[300 + i]) for i in range(30))


def test_pii_graph(spark):
    """Seeds, scored patterns and new spans of a random corpus, by brute force."""
    rng = random.Random(31)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = {"mail": lambda: f"u{digits(3)}@x.org", "call": lambda: f"+49 30 {digits(6)}", "host": lambda: f"10.0.{rng.randrange(300)}.{rng.randrange(256)}", "token =": lambda: f'"{rng.randrange(16**40):040x}"', "id": lambda: digits(rng.randint(3, 9)), "key": lambda: f"ab-{digits(5)}@"}
    docs = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(0, 4)):
            lead = rng.choice(list(make))
            parts += [rng.choice(["please", "The", "a", "x" * 70]), lead, make[lead if rng.random() < 0.8 else rng.choice(list(make))](), rng.choice(["now", "soon,", ".", "日本"])]
        docs.append((i if i % 9 else None, " ".join(parts) if i % 11 else None))
    docs += [docs[5], (5, f'see token = "hunter-20245-{digits(4)}" ok')]
    want = brute.pii_graph(docs)
    got = {}
    for r in pii.find(spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, kind long").selectExpr("struct(doc_id, kind) AS doc_id", "text")).collect():
        base = {tuple(b) for b in r.base}
        got[r.doc_id.kind] = {tuple(x) for x in r.spans if tuple(x) not in base}
    assert {k: v for k, v in got.items() if v} == dict(want) and len(want) > 100 and {k for v in want.values() for k, _, _ in v} >= {3, 4}
    assert want[len(docs) - 1]  # no hexadecimal digits, found by its context


def test_pii_many_matches(spark):
    n = 30_000
    docs = [(1, "1.1.1.1 " * n), (2, "x a@b.co 1234 " * n), (3, "1234 " * n + "a@b.co"), (4, '"' * n + "12345" + "." * n + "1")]
    out = {r.doc_id: (r.b, r.s) for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", F.size("base").alias("b"), F.size("spans").alias("s")).collect()}
    assert out[1] == (n, n) and out[2][0] == n and out[3][0] == 1 and out[4] == (0, 0)


# ----------------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    hostile = ["</turn>\n### user: x", "\\h\\l\\\\", "#" * 9, "<\\", "\\", "a\n\nb", "", None, "### assistant: </turn>", "\\c:\\"]
    table = [(c, t, ["user", "assistant", "tool: <x>#\\", None][(c + t) % 4], hostile[(3 * c + t) % len(hostile)]) for c in range(12) for t in range(c + 1)]
    table += [(50, 0, "user", "same"), (50, 0, "assistant", "turn"), (50, 1, "user", "x"), (50, 1, "user", "x"), (None, 3, "assistant", "no id")]
    m = chat.chain(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).cache()
    out = {r.tree: r for r in chat.format_paths(m, chat.best_paths(m)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", F.transform("loss_spans", lambda s: chat.unescape(F.substr("formatted", s["start"] + 1, s["length"])))).collect()}
    for c in {r[0] for r in table}:
        turns = sorted((r for r in table if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        assert [(b.role, b.text) for b in out[c].back] == [(r[2] or "", r[3] or "") for r in turns]
        assert out[c].loss == [r[3] or "" for r in turns if r[2] == "assistant"]


def test_chat_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"#{i}") for i in range(20_000)]
    m = chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    r = chat.format_paths(m, chat.best_paths(m)).first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [t.replace("#", "\\h") for _, _, who, t in rows if who == "assistant"]


def test_chat_trees(spark):
    #       1        5 (own parent: a root)   8 -> 9 -> 8 is a cycle; 11's parent is missing
    #     2   3
    #    4   6 7
    rows = [(0, 1, None, 1.0), (0, 2, 1, 1.0), (0, 3, 1, 5.0), (0, 4, 2, 9.0), (0, 6, 3, 1.0), (0, 7, 3, 1.0), (1, 5, 5, 0.0), (2, 8, 9, 1.0), (2, 9, 8, 1.0), (3, 11, 99, None), (3, 12, 11, None)]
    m = spark.createDataFrame([(*r, "user", "t") for r in rows], "tree long, node long, parent long, score double, role string, text string")
    path = lambda k: sorted((r.tree, r.rank, r.depth, r.node) for r in chat.best_paths(m, k).collect())
    assert path(1) == [(0, 1, 0, 1), (0, 1, 1, 2), (0, 1, 2, 4), (1, 1, 0, 5), (3, 1, 0, 11), (3, 1, 1, 12)]
    assert [r for r in path(2) if r[0] == 0 and r[1] == 2] == [(0, 2, 0, 1), (0, 2, 1, 3), (0, 2, 2, 6)]
    assert [r for r in path(9) if r[:2] == (0, 3)] == [(0, 3, 0, 1), (0, 3, 1, 3), (0, 3, 2, 7)]
    long = spark.range(1, 301).selectExpr("0L AS tree", "id AS node", "nullif(id - 1, 0) AS parent", "1.0D AS score")
    assert sorted((r.depth, r.node) for r in chat.best_paths(long).collect()) == [(i, i + 1) for i in range(300)]
    assert chat.best_paths(m.where("tree > 9")).collect() == []


def test_chat_random_trees(spark):
    """Branch scores, repeated messages, missing parents and cycles, by brute force."""
    rng = random.Random(21)
    rows = []
    for tree in [None, *range(30)]:
        n = rng.randint(1, 14)
        for node in range(n):
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                rows.append((tree, node, rng.choice([None, rng.randrange(n), rng.randrange(n), max(node - 1, 0), 99]), rng.choice([None, -1.0, 0.5, 2.0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None])))
        rows.append((tree, None, 0, 9.0, "user", "lost"))
    want = brute.tree_paths(rows)
    table = spark.createDataFrame([(*r[:4], r[4], r[5]) for r in rows], "tree long, node long, parent long, score double, role string, text string").repartition(5)
    m = chat.messages_of(table)
    paths = chat.best_paths(m, 3)
    got = {}
    for r in paths.collect():
        got.setdefault((r.tree, r["rank"]), {})[r.depth] = r.node
    assert {k: [v[d] for d in range(len(v))] for k, v in got.items()} == {k: [x[0] for x in v] for k, v in want.items()} and len(want) > 40
    back = chat.format_paths(m, paths).select("tree", "rank", chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert {(r.tree, r["rank"]): [(t.role, t.text) for t in r.turns] for r in back} == {k: [x[1:] for x in v] for k, v in want.items()}


def test_chat_repeated_messages_and_cycles(spark):
    twice = [(0, i, i - 1 if i else None, 1.0) for i in range(10)] * 2
    assert chat.best_paths(chat.messages_of(spark.createDataFrame([(*r, "user", "t") for r in twice], "tree long, node long, parent long, score double, role string, text string"))).count() == 10
    ring = spark.range(100).selectExpr("0L AS tree", "id AS node", "(id + 1) % 100 AS parent", "1.0D AS score")
    assert chat.best_paths(ring.union(spark.range(3).selectExpr("1L", "id", "nullif(id - 1, -1)", "1.0D"))).count() == 3


# ------------------------------------------------------------------- sharding


def test_sharding(spark, docs, rows, empty):
    for table, n in ((clash(docs.where("doc_id != 61 OR doc_id IS NULL")), len(rows) - 1), (spark.createDataFrame([(i, "same text") for i in range(400)] + [(1, "x")] * 40, "doc_id long, text string"), 440)):
        out = sharding.shard(table).collect()
        assert len(out) == n and sorted(map(str, sharding.shard(table).collect())) == sorted(map(str, out))
        by = {}
        for r in out:
            text = (r.text or "").encode()
            assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text) and r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
            by.setdefault(r.shard, []).append(r)
        assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
        mean, largest = sum(r["size"] for r in out) / 8, max(r["size"] for r in out)
        assert max(abs(sum(r["size"] for r in by.get(s, [])) - mean) for s in range(8)) <= largest + 0.01 * mean
    assert sharding.shard(empty).collect() == []
    one = sharding.shard(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_sharding_keeps_small_groups(spark):
    table = spark.createDataFrame([(i, prose(i // 3, 30)) for i in range(3000)], "doc_id long, text string")
    out = sharding.shard(table).groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count()
    assert out == 0


def test_splitters_by_size(spark):
    # One key with a third of all rows, and a few huge records: ranges are subdivided.
    keys = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 77L ELSE id * 384307168202282L END AS __k", "id AS __i", "0L AS __h", "0L AS __p", "1L AS __n", "CASE WHEN id % 500 = 1 THEN 5000L ELSE 10L END AS __t")
    total, n = keys.agg(F.sum("__t"), F.count("*")).first()
    cuts, sums = sharding.choose_splitters(keys, total, n)
    assert cuts == sorted(set(cuts)) and len(cuts) <= sharding.MAX_RANGES and sum(r[1] for r in sums) == total
    assert max(r[1] for r in sums) <= 2 * sharding.OVERFULL * total / sharding.MIN_RANGES + 5000
    assert all(r["__r"] == sum(c <= (r["__k"], r["__i"], 0, 0) for c in cuts) for r in sharding._ranged(keys, cuts).collect())


def test_sharding_parts_equal_rows(spark):
    """Rows that no key can part, of one text and no id, fill shards evenly; with texts and without."""
    table = spark.createDataFrame([(None, "same text", "s")] * 900 + [(i, prose(i, 5), "t") for i in range(300)] + [(None, None, "s"), (None, "", "s")] * 9, "doc_id long, text string, source string")
    for carry in (None, ["doc_id"]):
        out = sharding.shard(table, carry=carry).collect()
        sizes = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
        assert len(out) == 1218 and max(sizes) - min(sizes) <= 200 and all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(8))
    whole = sharding.shard(table).collect()
    assert sorted(str((r.doc_id, r.text, r.source)) for r in whole) == sorted(str(tuple(r)) for r in table.collect())
    named = sharding.shard(table.selectExpr("concat('d', doc_id) AS doc_id", "text"))
    assert named.count() == 1218 and named.columns[:2] == ["doc_id", "text"]


# ------------------------------------------------------------ decontamination


def test_decontamination(spark, rows, empty):
    rng = random.Random(8)
    items = [(i, prose(9000 + i, rng.randint(6, 40))) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (60, prose(9100, 9)), (None, prose(9200, 12))]
    docs = [r[:2] for r in rows if r[0] not in (60, 61)]
    for k in range(40):
        w, base = brute.words(items[k % 12][1]), brute.words(prose(k, 30))
        for _ in range(rng.randint(0, 1)):
            w[rng.choice([0, -1])] = "other"
        at = rng.randint(0, len(base))
        docs.append((1000 + k, " ".join(base[:at] + w + base[at:])))
    docs += [(2000, items[3][1]), (2001, items[3][1].rsplit(" ", 1)[0]), (2002, items[15][1])]
    table, bench = clash(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontam.contaminated(table, bench).collect()}
    want = brute.contaminated(docs, items)
    assert got == want and {k[0] for k in want} >= {2000, 2002} and len(want) > 25
    clean = decontam.decontaminate(table, bench)
    assert clean.columns == table.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in {k[0] for k in want})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(table, none).collect() == [] and decontam.decontaminate(table, none).count() == len(docs)
    assert decontam.contaminated(empty, bench).collect() == [] and decontam.decontaminate(empty, bench).collect() == []


def test_decontamination_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(decontam, "_STEP", 50)
    items = [(i, prose(9000 + i, 12 + i)) for i in range(4)]
    parts = [items[i % 4][1] if i % 3 else prose(i, 15) for i in range(200)]
    docs = [(1, " ".join(parts)), (2, " ".join(items[1][1].split()[:-1] + ["x"] + parts[:9])), (3, prose(77, 4000))]
    got = decontam.Items(items).search(pa.array([t for _, t in docs]))
    assert {(docs[d][0], i): (round(s, 9), a) for d, i, a, _, s in got} == brute.contaminated(docs, items)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 3)
    items = [(i, prose(9000 + i, 20)) for i in range(10)]
    docs = [(i, prose(i, 10) + " " + items[i][1]) for i in range(10)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(10)]
    # Items that repeat a text are one in a block, and all of them match.
    items = [(i, prose(9000, 20)) for i in range(50)] + [(None, prose(9000, 20)), (50, prose(9001, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert max(len(b) for b in decontam.item_blocks(bench, "text")) <= 2
    table = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string")
    got = decontam.contaminated(table, bench.selectExpr("concat('i', item_id) AS item_id", "text")).collect()
    assert sorted(map(str, {(r.doc_id, r.item_id) for r in got})) == sorted(map(str, [("d0", f"i{i}") for i in range(50)] + [("d0", None), ("d1", "i50")])) and len(got) == 52


def test_all_fingerprints_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(6)
    items = decontam.Items([(i, prose(i, 25)) for i in range(30)])
    flips = np.packbits(np.array([rng.permutation(128) < rng.integers(0, 45) for _ in range(400)]), axis=1).view(">u2").astype(np.uint16)
    sign = items.sign[rng.integers(0, 30, 400)] ^ flips
    got = {(w, i) for part in items.candidates(sign, np.full(400, 25)) for w, i in zip(*(x.tolist() for x in part), strict=True)}
    want = {(w, i) for w in range(400) for i in range(30) if int(np.bitwise_count(sign[w] ^ items.sign[i]).sum()) <= decontam.RADIUS}
    assert got == want and len(want) > 100


# ---------------------------------------------------------------- language ID


def test_language(spark, empty):
    from tidemark.llm.language_id import codewords

    alphabets = {"aa": "abcdefg", "bb": "éèàôùçî", "cc": "äöüßnmk", "dd": "ñóíáúqz"}
    rng = random.Random(11)
    text = lambda lang: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(20))
    known = [(i, text(lang), lang) for i, lang in enumerate(list(alphabets) * 40)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 \n$$$ 日", "cc"), (903, "456 --- 7", "dd"), (904, text("aa"), None), (None, text("bb"), "bb")]
    table = clash(spark.createDataFrame(known + odd, "doc_id long, text string, lang string"))
    model = language_id.train(table.where(~language_id.held_out(F.col("doc_id"))))
    out = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    assert len(out) == len(known + odd) and all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, _, lang in known)
    assert [out[i].lang_pred for i in (900, 901, 902, 903, 904, None)] == ["und", "und", out[902].lang_pred, "und", "aa", "bb"] and out[902].lang_pred != "und" and out[900].score == 0
    kept = language_id.keep_identified(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(out) - {900, 901, 903}
    assert language_id.train(empty) is None and {r.lang_pred for r in language_id.identify(table, None).collect()} == {"und"} and language_id.identify(empty, model).collect() == []
    alone = language_id.train(table.where("lang = 'aa'"))
    assert {r.lang_pred for r in language_id.identify(table.where("doc_id < 20"), alone).collect()} == {"aa"}
    assert language_id.identify(spark.createDataFrame([(1, known[0][1] * 500)], "doc_id long, text string"), model).first().lang_pred == "aa"
    for k in (2, 3, 4, 6, 7, 30):
        code = codewords(k)
        assert len({tuple(r) for r in code}) == k and all(0 < c.sum() < k for c in code.T)


def test_foreign_texts_are_rejected(spark):
    """The classifier drops what is in none of the learned languages; without labels all stay."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    foreign = [(-1, "Это русский текст о погоде и природе и ещё немного слов для длины."), (-2, "Tämä on suomenkielinen teksti jossa puhutaan säästä ja luonnosta"), (-3, "日本語の文章です。天気がいいですね。今日は良い日です。")]
    table = docs.union(spark.createDataFrame([(i, t, None) for i, t in foreign], docs.schema))
    model = language_id.train(table)
    kept = {r.doc_id for r in language_id.keep_identified(table, model).collect()}
    assert not kept & {-1, -2, -3} and len(kept) >= 0.99 * docs.where("text RLIKE '[a-z]'").count()
    only = {r.lang_pred for r in language_id.identify(language_id.keep_identified(table, model, languages=["en"]), model).collect()}
    assert only == {"en"}
    none = table.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(none, language_id.train(none)).count() == table.count()


def test_language_decoding(spark):
    """Loss-weighted decoding, loop by loop."""
    import math

    import numpy as np

    model = language_id.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    langs, code, w = model
    x = language_id.features(pa.array([prose(i, 12) for i in range(9)] + ["Le chat est là", "die Katze und der Hund"]))
    best, score, unsure, near = language_id.decode(model, x)
    for r in range(len(x)):
        bits = [float(np.dot(x[r], w[:-1, b]) + w[-1, b]) for b in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m if c else m)) for m, c in zip(bits, word, strict=True)) / len(bits) for word in code]
        order = sorted(loss)
        assert best[r] == loss.index(order[0]) and near[r] == pytest.approx(order[0], abs=1e-4) and bool(unsure[r]) == (order[1] - order[0] < language_id.MARGIN)
        assert score[r] == pytest.approx(1 / sum(math.exp(len(bits) * (order[0] - v)) for v in loss), abs=1e-3)


def test_fits_are_repeatable(spark):
    """Equal models however the rows are partitioned, and whatever rows repeat."""
    import numpy as np

    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    urls = url_filter.labelled_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).cache()
    shuffled = lambda df, n: df.union(df).repartition(n, F.rand(n))
    fits = {
        "language": lambda n: language_id.train(shuffled(docs, n))[2],
        "quality": lambda n: np.append(quality.train(shuffled(docs, n), shuffled(labels, n + 1))[0], quality.train(shuffled(docs, n), labels)[1:]),
        "url": lambda n: np.concatenate([np.ravel(x) for x in vars(url_filter.train(shuffled(urls, n))[0]).values()]),
    }
    for name, fit in fits.items():
        one, two = fit(2), fit(7)
        assert one.shape == two.shape and np.allclose(one, two, rtol=0, atol=0, equal_nan=True), name


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    import numpy as np

    from tidemark.llm import _learn

    texts = pa.array(["Ab cd é日 " * 40, None, "", "x", "yz" * 33])
    whole = _learn.char_features(texts, 10, range(1, 4))
    for n in (1, 2, 7, 64):
        monkeypatch.setattr(_learn, "POINTS", n)
        assert np.array_equal(_learn.char_features(texts, 10, range(1, 4)), whole)


def test_held_out(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", language_id.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


# ------------------------------------------------------------------------ URL


def test_url_rules(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "https://Q.EXAMPLE.net/en/1?x#y": ("q.example.net", "/en/1", "example.net/en/", "allow"), "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://example.com/de": ("example.com", "/de", None, "allow"), "http://x.org/fr/?": ("x.org", "/fr/", "org/fr/", "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "no scheme/net/": ("", "", None, "allow"), "a://b://c.net/": ("b:", "//c.net/", None, "allow"), "http://É.net/": ("É.net", "/", "net/", "block"), "http://org/fr/": ("org", "/fr/", "org/fr/", "allow"), "x" * 100_000: ("", "", None, "allow"),
    }
    table = spark.createDataFrame([(u,) for u in cases] * 2, "url string").selectExpr("*", "1 AS host", "2 AS rule")
    out = url_filter.judge(table, None).collect()
    assert len(out) == 2 * len(cases) and all((r.host, r.path, r.rule, r.verdict) == cases[r.url] for r in out)
    assert url_filter.judge(table.limit(0), None).collect() == []


def test_url_trees(spark):
    rng = random.Random(12)
    label = [(f"https://good{i % 7}.example.org/a/b{rng.randint(0, 9999)}", 0) for i in range(500)] + [(f"http://x{rng.randint(0, 9999)}-cheap.biz/{rng.randint(0, 99999)}?a=1&b=2&c={i}", 1) for i in range(400)] + [(None, 1), ("http://z.com/", None)]
    model = url_filter.train(spark.createDataFrame(label, "url string, label int"))
    new = [("https://good3.example.org/a/b77", "allow"), ("http://q9-cheap.biz/777?a=2&b=4&c=9", "block")]
    out = {r.url: r for r in url_filter.judge(spark.createDataFrame(new, "url string, said string"), model).collect()}
    assert all(out[u].verdict == said and 0 < out[u].p_block < 1 for u, said in new)
    nulls = url_filter.judge(spark.createDataFrame([(None,), ("",), ("日本" * 9,)], "url string"), model).collect()
    assert len(nulls) == 3
    assert url_filter.train(spark.createDataFrame([("http://a.b/", 0)], "url string, label int")) is None
    noise = url_filter.train(spark.createDataFrame([(f"http://h{i}.com/{i}", rng.randint(0, 9) // 9) for i in range(600)], "url string, label int"))
    assert all(r.p_block < 0.5 for r in url_filter.judge(spark.createDataFrame([(f"http://h{i}.com/{i}",) for i in range(700, 760)], "url string"), noise).collect())


def test_keep_one_verifies_lone_pairs(spark):
    """Pairs of similarity 0.8 go, of 0.75 stay, though no third copy links them."""
    rng = random.Random(9)
    docs, lone, unlike = [], [], []
    for i in range(120):
        w = [f"w{rng.randrange(10**6)}" for _ in range(185 if i < 60 else 184)]
        changed = list(w)
        for at in (20, 60, 100, 140) if i < 60 else (20, 50, 80, 110, 140):  # each changes five shingles
            changed[at] += "x"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed))]
        (lone if i < 60 else unlike).append(2 * i + 1)  # 161/201 = 0.801, 155/205 = 0.756
    kept = {r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(120)} | set(unlike) <= kept and len(kept & set(lone)) <= 2


def test_keep_one_large_groups(spark):
    """A family of near copies in thinned groups and in tiles, against all pairs."""
    rng = random.Random(10)
    base, docs = [f"w{i}" for i in range(200)], []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(0, 7)):
            w[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in docs]
    label = list(range(150))
    for i in range(150):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    want = {min(i for i in range(150) if label[i] == x) for x in set(label)}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(want) > 1
    for group in (2048, 16):
        assert {r.doc_id for r in near_dedup.keep_one(table, group=group).collect()} == want


def test_rows_of_full_groups_grow_with_the_family(spark):
    """Doubling a family doubles the rows of its groups; who isn't in its class still meets everyone."""
    made = []
    for n in (64, 128):
        nodes = spark.range(n).selectExpr("id AS node", "transform(sequence(1, 24), x -> shiftleft(7L, x)) AS fp", "100L AS shingles", "least(id, 3L) AS class")
        full = near_dedup.full_groups(nodes, 16)
        assert full.count() == 96
        early = near_dedup.tiles(nodes.drop("class"), full)
        assert early.groupBy("key").count().agg(F.max("count")).first()[0] <= 32
        late = near_dedup.class_tiles(nodes, near_dedup.class_shares(nodes, full, 16)).collect()
        made.append(early.count() + len(late))
        meet = {}
        for r in late:
            meet.setdefault(r.key, set()).add(r.node)
        assert max(map(len, meet.values())) <= 32
        for i in range(3):
            assert set().union(*(x for x in meet.values() if i in x)) == set(range(n))
    assert made[1] < 2.2 * made[0]
    one = nodes.withColumn("class", F.lit(0).cast("long"))
    assert near_dedup.class_tiles(one, near_dedup.class_shares(one, full, 16)).isEmpty()


def test_group_pairs_of_classes():
    """Only pairs of different classes are handed on, and only they make a group crowded."""
    import numpy as np

    key, fp = _noisy_groups()
    node, of = np.arange(140) + 7, np.where(key == 1, 5, np.arange(140) % 3)
    want = {(i, j) for i in range(140) for j in range(i) if key[i] == key[j] and of[i] != of[j] and int(fp[i] ^ fp[j]).bit_count() <= 12}
    got, crowded = set(), set()
    for a, b, k in near_dedup.group_pairs(key, fp, node, 12, of):
        got |= {(int(max(x, y)) - 7, int(min(x, y)) - 7) for x, y in zip(a, b, strict=True)}
        crowded |= set(k.tolist())
    assert 1 not in crowded
    assert crowded == {g for g in range(3) if sum(key[i] == g for i, _ in want) > near_dedup.MANY * (key == g).sum()}
    assert got == {p for p in want if key[p[0]] not in crowded}


def test_keep_one_decides_per_row(spark):
    """Unrelated texts under one id are two documents."""
    docs = [(1, prose(1)), (1, prose(2)), (2, prose(2)), (None, prose(1)), (None, prose(3)), (3, prose(3)), (3, prose(3))]
    kept = near_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, prose(1)), (1, prose(2)), (3, prose(3))])


def test_distinct_shingles_of_a_long_text():
    from tidemark.llm.simhash import fingerprints, shingle_sets

    text = " ".join(f"w{i}" for i in range(230_000))  # over two blocks, without repeats
    texts = pa.array([text, "one two"])
    a, b = (fingerprints(texts, 5, 2, sets=d) for d in (shingle_sets(texts, 5), None))
    assert (a == b).all()


def test_near_dups_of_null_and_repeated_ids(spark):
    """A chain over a row without an id, and one id of two unrelated texts."""
    rng, words = random.Random(12), prose(800, 300).split()
    fp = lambda w: brute.simhash(" ".join(w))
    apart = lambda x, y: (fp(x) ^ fp(y)).bit_count()

    def change(w):
        w = list(w)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        return w

    middle = next(w for w in (change(words) for _ in range(5000)) if 1 <= apart(w, words) <= 3)
    end = next(w for w in (change(middle) for _ in range(5000)) if 1 <= apart(w, middle) <= 3 < apart(w, words))
    docs = [(5, " ".join(words)), (None, " ".join(middle)), (2, " ".join(end))]
    docs += [(900, " ".join(change(words) * 1)), (900, prose(801, 300)), (None, prose(802, 300))]
    _, component = brute.near_components(docs)
    got = {(r.id, r.fp[0] % 2**64): r.component for r in near_dedup.near_dups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(d, brute.simhash(t)): c for (d, t), c in zip(docs, component, strict=True)}
    assert component[:3] == [2, 2, 2] and component[4:] == [900, None]


def test_decontamination_by_short_items(spark):
    items = [(1, "Alpha beta"), (2, "one two three four"), (3, prose(9100, 20)), (4, ""), (5, "solo")]
    docs = [(10, "x alpha BETA alpha beta"), (11, "alpha gamma beta"), (12, "one two three four"), (13, "one two three"), (14, "y alpha"), (15, "beta z"), (16, "a solo " + items[2][1])]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontam.contaminated(table, bench).collect()}
    assert got == {(10, 1): (1, 2, 1.0), (12, 2): (0, 4, 1.0), (16, 3): (2, 20, 1.0), (16, 5): (1, 1, 1.0)}
    assert {r.doc_id for r in decontam.decontaminate(table, bench).collect()} == {11, 13, 14, 15}
    short = spark.createDataFrame(items[:2], "item_id long, text string")
    assert {r.doc_id for r in decontam.decontaminate(table, short).collect()} == {11, 13, 14, 15, 16}
