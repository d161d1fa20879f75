"""The pipeline against brute force, stage by stage, on a small corpus with planted cases."""

import os
import re

import pytest

from fernwave.llm import pii

from .test_decontam import brute as brute_contamination
from .test_pii import brute as brute_spans
from .test_simjoin import brute as brute_classes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    some = docs.orderBy("doc_id").limit(60)
    base = [r for r in some.collect() if r.text and len(r.text.split()) > 80][:3]
    item = items.orderBy("item_id").first().text
    extra = [
        (9001, base[0].text, "en", "s"), (9002, base[1].text + " tail", "en", None), (9003, "123 456 ...", "en", "s"), (9004, None, "en", "s"), (9005, "", None, "s"),
        (9006, f"Anor the {item} of the inan", "en", "s"), (9007, "the of anor thed mail jo@mail.example.com or +44 20 7946 0958 there 4111 1111 1111 1111 ered", "en", "s"),
    ]
    planted = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in extra], "doc_id long, text string, lang string, source string, n_chars long")
    some.unionByName(planted).write.parquet(f"{d}/documents.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_match_brute_force(spark, corpus):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "jaccard_join", "decontamination", "personal_data", "source_mix"]
    stage = dict(p.STAGES)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    one = stage["language_id"](spark, docs, corpus).persist()
    assert one.columns == docs.columns
    assert {d for d, _ in rows(docs)} - {d for d, _ in rows(one)} == {d for d, t in rows(docs) if not re.search(r"[^\W\d_]", t or "")}

    two = stage["jaccard_join"](spark, one, corpus).persist()
    assert two.columns == docs.columns
    assert rows(two) == sorted(r for r, c in zip(rows(one), brute_classes(rows(one))) if c[0] == c[1])
    assert not {9001, 9002} & {d for d, _ in rows(two)}

    three = stage["decontamination"](spark, two, corpus).persist()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(rows(two), items) if r[5]}
    assert 9006 in bad and rows(three) == [r for r in rows(two) if r[0] not in bad] and three.columns == docs.columns

    four = stage["personal_data"](spark, three, corpus).persist()
    assert four.columns == docs.columns
    for (d, t), (e, u) in zip(rows(three), rows(four)):
        spans = brute_spans(t)
        assert d == e and (u != t) == any(spans.values()) and not any(brute_spans(u)[k] for k in pii.KINDS)
    assert {r.doc_id: r.text for r in four.collect()}[9007].count("[") == 3

    five = stage["source_mix"](spark, four, corpus).collect()
    assert sorted((r.doc_id, r.text) for r in five) == rows(four)
    for r in five:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and r.taken <= 3 * r["size"]
    for s in {r.source for r in five}:
        own = [r for r in five if r.source == s]
        assert sum(r["size"] for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 256


def test_run_gives_the_last_stage(spark, corpus):
    import corpus_pipeline as p

    out = p.run(spark, corpus)
    assert {"doc_id", "text", "taken", "target", "source_size"} <= set(out.columns) and 9004 not in {r.doc_id for r in out.select("doc_id").collect()}
