from __future__ import annotations

import re

import pytest

import corpus_pipeline
from quarrymill.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def steps(spark, odd, tmp_path_factory):
    top, out, docs = tmp_path_factory.mktemp("steps"), [odd], odd
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, "unused").write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out.append(docs)
    return out


def test_each_stage_on_odd_rows(odd, steps):
    told, unique, apart, mixed, packed = steps[1:]
    assert all(d.columns == odd.columns for d in (told, unique, apart, mixed))
    assert {r["doc_id"] for r in told.collect()} == {1, 2, 3, 7, 8, 9, 10, 12, None}
    texts = [re.sub(r"\s", "", r["text"]) for r in unique.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", r["text"]) for r in told.collect()})
    assert apart.count() <= unique.count() and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in apart.collect()}
    words = lambda d: sum(len((r["text"] or "").split()) for r in d.collect())
    assert words(mixed) <= 2 * words(apart)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = found.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    kept = {r["doc_id"] for r in rows}
    # Clean documents may be mixed down, but of exact copies only one is there.
    norm = [re.sub(r"\s", "", docs[i]) for i in kept]
    assert len(norm) == len(set(norm)) and len(kept) > 0.5 * len(docs)
    assert fingerprint(docs[next(iter(kept))]) is not None


def test_no_documents(spark, none):
    docs = none
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "unused")
    assert docs.count() == 0
