"""The whole pipeline on a small corpus, against its stages stated plainly."""

import importlib.util
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=50):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


@pytest.fixture
def corpus(spark, tmp_path):
    docs = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(40)]
    docs += [(100 + i, text(i % 4), "en", "s0", 1) for i in range(12)]  # copies of 0 to 3
    items = [(i, text(500 + i, 15)) for i in range(5)]
    docs += [(200 + i, text(600 + i, 20) + " " + items[i][1] + " " + text(700 + i, 20), "en", "s1", 1) for i in range(5)]
    docs += [(300, None, "en", "s2", 0), (301, "123 456 $$$", "en", "s2", 1), (302, "", None, None, None)]
    docs += [(400, text(900), None, None, None), (401, text(901), "en", None, 7)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, items, str(tmp_path)


def test_run(spark, corpus):
    docs, items, path = corpus
    out = corpus_pipeline.run(spark, path).collect()
    left = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    first = {}
    for d in left:
        first.setdefault(d[1], d)
    left = [d for d in left if first[d[1]] is d]
    bad = {d for d, _ in brute.contaminated([d[:2] for d in left], items)}
    left = [d for d in left if d[0] not in bad]
    assert bad == {200, 201, 202, 203, 204} and len(left) == 42
    by_id = {d[0]: d for d in left}
    assert {r.doc_id for r in out} <= set(by_id)
    sizes, took = {}, {}
    for d in left:
        sizes[d[3]] = sizes.get(d[3], 0) + len(brute.words(d[1]))
    for r in out:
        assert by_id[r.doc_id][1].startswith(r.text) and (r.lang, r.source, r.n_chars) == by_id[r.doc_id][2:]
        took[r.source] = took.get(r.source, 0) + len(brute.words(r.text))
    want = brute.targets(sizes)
    assert all(abs(took.get(s, 0) - want[s]) <= 1 for s in sizes)
    shards = {}
    for r in out:
        assert r["size"] == len(r.text.encode()) + 1
        shards.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in shards.values())
    mean = sum(r["size"] for r in out) / 8  # copies of one document have one key and stay together
    assert all(abs(sum(x["size"] for x in v) - mean) <= 2 * max(r["size"] for r in out) for v in shards.values())


def test_stages(spark, corpus):
    _, _, path = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
