from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrymill.llm.packing import Index, fill_windows, op3_bm25_packing, pack_documents


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, docs, ids_of, window=1024):
    """An exact round trip: each document's pieces make up its ids, each sequence is filled without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc_id, text in docs.items():
        at, ids = 0, ids_of(text)
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            if "ids" in p:
                assert np.frombuffer(p["ids"], "<u4").tolist() == ids[at : at + p["length"]]
            else:
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    short = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        short += at < window
    return short


def test_round_trip(odd, none, ids_of):
    docs = {r["doc_id"]: r["text"] for r in odd.where("doc_id IS NOT NULL AND doc_id <> 8").collect()}
    pieces = [r.asDict() for r in pack_documents(odd.where("doc_id IS NOT NULL AND doc_id <> 8")).collect()]
    assert check(pieces, docs, ids_of) == 1
    both = pack_documents(odd).collect()
    assert sum(p["length"] for p in both) == sum(len(ids_of(r["text"])) for r in odd.collect())
    assert pack_documents(none).count() == 0


def test_special_tokens_that_a_text_spells(table, ids_of):
    docs = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "<|endoftext|><|endoftext|> <|endof text|>", 4: "x\n<|endoftext|>\n"}
    assert 50256 in ids_of(docs[1])
    check([r.asDict() for r in pack_documents(table(list(docs.items()))).collect()], docs, ids_of)


def test_more_shards_than_tasks_and_a_token_that_all_share(table, ids_of, monkeypatch):
    monkeypatch.setattr("quarrymill.llm.packing.SHARD", 20)
    docs = {i: f"zebra {'quux ' * (i % 4)}{i % 7}" for i in range(400)}
    pieces = [r.asDict() for r in pack_documents(table(list(docs.items())), window=64).collect()]
    assert check(pieces, docs, ids_of, 64) <= 40


def test_rows_without_an_id(table):
    pieces = pack_documents(table([(None, "one two"), (-1, "three")])).collect()
    assert sorted(p["doc_id"] is None for p in pieces) == [False, True]


def test_small_window(table, ids_of):
    docs = {i: f"text number {i} " * (i % 9) for i in range(60)}
    pieces = [r.asDict() for r in pack_documents(table(list(docs.items())), window=16).collect()]
    assert check(pieces, docs, ids_of, 16) <= 4


def test_neighbours_share_words():
    tails = [np.arange(10) + 100 * (i % 3) for i in range(9)]
    frequency = np.full(400, 3)
    windows = list(fill_windows(tails, Index(tails, frequency, 9, 10.0), 30))
    assert [sorted({j % 3 for j, _, _ in w}) for w in windows] == [[0], [1], [2]]
    assert sorted((j, s, n) for w in windows for j, s, n in w) == [(i, 0, 10) for i in range(9)]


def test_scores_are_bm25():
    tails = [np.array([1, 1, 2]), np.array([2, 3]), np.array([4])]
    frequency = np.array([0, 1, 2, 1, 1])
    index = Index(tails, frequency, 3, 2.0)

    def weight(t, d):
        f = (tails[d] == t).sum()
        return np.log1p((3 - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tails[d]) / 2.0))

    wanted = [[sum(weight(t, d) for t in set(tails[q].tolist()) if t in tails[d]) for d in range(3)] for q in range(3)]
    assert np.allclose([index.scores(q) for q in range(3)], wanted, rtol=1e-6)
    index.keep(np.array([True, False, True]))
    assert index.scores(0)[1] == 0 and np.isclose(index.scores(0)[0], wanted[0][0])


def test_query(spark, ids_of):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert check([r.asDict() for r in op3_bm25_packing(spark, "/root/testdata/sf0.001").collect()], docs, ids_of) <= 1
