"""The registered queries of the subpackage, run as they are, against their SQL or
a plain statement of their results, at the smallest scale."""

import os
import re
import sys
import zlib
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidemark import llm  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name):
    return llm.queries()[name](spark, DATA)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    out = run(spark, name)
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    rel = duck.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(out.columns)
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(tuple(map(show, r)) for r in out.select(*columns).collect()) == sorted(tuple(map(show, r)) for r in rel.fetchall())


def test_op1(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    out = run(spark, "op1_url_filters").collect()
    assert sorted(r.page_id for r in out) == sorted(urls)
    for r in out:
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (brute.fold(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, said) for said, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        assert (r["rule"], r.verdict) == max(fits)[1:] if fits else r["rule"] is None


def test_op6(spark, docs):
    for r in run(spark, "op6_pii").collect():
        base = brute.pii(docs[r.doc_id].text)
        kinds = [x.split(":")[0] for x in base.split(",")]
        assert r.base_sha256 == brute.sha(base) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert set(base.split(",")) - {""} <= set(r.spans.split(",")) and r.n_spans == len([x for x in r.spans.split(",") if x])


def test_op8(spark, docs):
    out = run(spark, "op8_sharding").collect()
    assert sorted(r.doc_id for r in out) == sorted(docs) and {r.law for r in out} == {"bytes"}
    mean, largest = sum(r["size"] for r in out) / 8, max(r["size"] for r in out)
    for s in range(8):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r["size"] for r in own) - mean) <= largest + 0.02 * mean
    for r in out:
        text = (docs[r.doc_id].text or "").encode()
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text)


def test_op10(spark, docs):
    out = run(spark, "op10_language_id").collect()
    known = {d.lang for d in docs.values() if d.lang}
    for r in out:
        text = docs[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred in known) == any(c.isalpha() for c in text or "") and r.lang_pred in known | {"und"}
    held = [r.lang_pred == docs[r.doc_id].lang for r in out if r.held_out and r.lang_pred != "und"]
    assert len(out) == len(docs) and sum(held) >= 0.95 * len(held)
