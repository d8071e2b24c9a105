from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from quarrymill.llm import language_id, toxicity
from quarrymill.llm.language_id import build_parser, keep_identified, op9_language_id, phrases, predict, suffix_automaton
from quarrymill.llm.toxicity import Features, ftrl, op10_toxicity, score_texts


def greedy(sample, text):
    """Phrases of text by brute force: longest substrings of sample, one after the other; a character that sample lacks is one."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_automaton_accepts_all_substrings():
    draw = random.Random(1)
    codes = [draw.randrange(3) for _ in range(60)]
    go = suffix_automaton(codes)
    subs = {tuple(codes[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 8))}
    for _ in range(3000):
        word = tuple(draw.randrange(3) for _ in range(draw.randrange(1, 8)))
        state = 0
        for c in word:
            state = go[state].get(c) if state is not None else None
        assert (state is not None) == (word in subs)


@pytest.mark.parametrize("lane, lead", [(40, 8), (7, 1), (16, 0), (2048, 256)])
def test_phrases_by_brute_force(monkeypatch, lane, lead):
    """Texts in lanes have the phrases of one parse, also where the lanes' parses don't meet."""
    monkeypatch.setattr(language_id, "LANE", lane)
    monkeypatch.setattr(language_id, "LEAD", lead)
    samples = {"a": "the cat sat on the mat and the dog", "b": "le chat est sur la table", "c": "aaaaaaaaaaa", "d": "xyz" * 9}
    parser = build_parser(samples, most_classes=8)
    draw = random.Random(3)
    texts = ["the cat is on la table", "x", "", "zzz the", "the cat sat on the mat " * 7, "a" * 300, "xyz" * 100, "éa" * 60, "".join(draw.choice("the cat léxyz") for _ in range(500))]
    found = phrases(parser, texts)
    for i, t in enumerate(texts):
        for j, k in enumerate(parser.languages):
            assert found[i, j] == greedy(samples[k], t), (t, k)


def test_sample_reaches_all_parts_of_a_text(table, monkeypatch):
    """Passages are drawn from anywhere in a text, and from the whole of it where the sample has room."""
    samples = {}
    monkeypatch.setattr(language_id, "build_parser", samples.update)
    texts = [chr(ord("a") + i) * 700 + chr(ord("k") + i) * 700 for i in range(10)]
    language_id.train(table([(i, t, "xx") for i, t in enumerate(texts)]), chars=100_000)
    learned = [i for i in range(10) if not zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(samples["xx"].replace(" ", "")) == sorted("".join(texts[i] for i in learned))
    language_id.train(table([(1, "".join(texts) * 20, "xx")]), chars=20_000)
    assert len(samples["xx"]) == 20_000 and len(set(samples["xx"])) == 21


def test_predictions():
    parser = build_parser({"en": "the quick brown fox jumps over the lazy dog and runs away " * 3, "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg " * 3, "xx": ""})
    langs, score = predict(parser, ["The lazy fox", "der faule Hund", None, "", "123 !?", "the dog " * 50_000])
    assert langs == ["en", "de", "und", "und", "und", "en"]
    assert (score[:2] > 0.5).all() and (score[2:5] == 0).all() and (score <= 1).all()
    assert predict(build_parser({}), ["some text"])[0] == ["und"]


def test_identify_odd_rows(odd, none):
    parser = language_id.train(odd)
    found = language_id.identify_languages(odd, parser)
    assert found.columns == [c for c in odd.columns if c.lower() not in ("lang_pred", "score")] + ["lang_pred", "score"]
    by = {r["doc_id"]: r["lang_pred"] for r in found.collect()}
    assert all(by[i] == "und" for i in (4, 5, 6, 11))
    left = keep_identified(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 7, 8, 9, 10, 12, None}
    assert keep_identified(none).count() == 0


def test_held_out_accuracy(spark):
    found = {r["doc_id"]: r for r in op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(found) == len(docs)
    assert all(found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in docs)
    right = [found[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs if found[r["doc_id"]]["held_out"]]
    assert sum(right) >= 0.97 * len(right)


def test_features():
    f = Features()
    assert len(f.of("a b c")) == 3 + 2 + 1 and len(f.of("a")) == 1 and len(f.of("")) == len(f.of(None)) == 0
    assert f.of("A b").tolist() == f.of("a, B!").tolist()
    assert f.of("a x c")[-1] == f.of("a y c")[-1]
    small = Features(remembered=1)
    assert small.of("a b c d").tolist() == small.of("a b c d").tolist()


def test_ftrl_learns_and_stays_sparse():
    draw = random.Random(0)
    rows = [(" ".join(draw.choice("abcdefgh") for _ in range(20)) + (" vile" if i % 4 == 0 else " kind"), int(i % 4 == 0)) for i in range(400)]
    model = ftrl(rows)
    assert 0 < len(model.index) < 200
    score = score_texts(model, ["a vile b", "a kind b", "", None], model.dense(), Features())
    assert score[0] > 0.5 > score[1] and score[2] == score[3]
    assert score_texts(ftrl([]), ["x"], np.zeros(1 << toxicity.BITS), Features())[0] == 0.5


def test_score_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(odd, toxicity.train(odd, labels))
    assert found.columns == [c for c in odd.columns if c.lower() not in ("score", "predicted")] + ["score", "predicted"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.collect()) and found.count() == odd.count()
    assert toxicity.score_toxicity(none, toxicity.train(none, labels.where("false"))).count() == 0


def test_held_out_toxicity(spark):
    found = {r["doc_id"]: r for r in op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(found[i]["score"], t) for i, t in labels.items() if i in found and found[i]["held_out"] and t is not None]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.95
    assert np.mean([s >= 0.5 for s in neg]) < 0.01


def test_characters_beyond_the_most_frequent_count():
    """Many scripts, and languages of thousands of characters: each is told by the characters that only the order tells apart."""
    draw = np.random.default_rng(8)
    samples, texts = {"latin": "the cat sat on the mat and went home " * 900}, []
    for n, first in enumerate((0x4E00, 0x4E00, 0xAC00, 0x20000)):
        words = ["".join(chr(first + int(c)) for c in draw.integers(0, 1_500, 3)) for _ in range(400)]
        samples[f"l{n}"] = " ".join(draw.choice(words, 3_000))
        texts.append(" ".join(draw.choice(words, 30)))
    parser = build_parser(samples)
    assert predict(parser, texts)[0] == ["l0", "l1", "l2", "l3"]
    few = {"a": "abab cab", "b": "bcbc dab é", "c": "éèü dcba"}
    wide, narrow = build_parser(few), build_parser(few, 3)
    assert np.array_equal(phrases(wide, ["abcdéè x", "dcba cab"]), phrases(narrow, ["abcdéè x", "dcba cab"]))


def test_ftrl_against_one_coordinate_at_a_time():
    """The update rule of each coordinate, spelled out in plain numbers over dictionaries."""
    draw = random.Random(2)
    rows = [(" ".join(draw.choice(["good", "bad", "ugly", "fine", "so", "what"]) for _ in range(draw.randrange(0, 9))), draw.randrange(2)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.7, 0.01
    z, n, make = {}, {}, toxicity.Features()

    def weight(c):
        push = 0.0 if c == "bias" else l1
        v = z.get(c, 0.0)
        return 0.0 if abs(v) <= push else -(v - math.copysign(push, v)) / ((beta + math.sqrt(n.get(c, 0.0))) / alpha + l2)

    for _ in range(3):
        for text, label in rows:
            there = [*set(make.of(text).tolist()), "bias"]
            weights = {c: weight(c) for c in there}
            slope = 1 / (1 + math.exp(-sum(weights.values()))) - label
            for c in there:
                seen = n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + slope - (math.sqrt(seen + slope * slope) - math.sqrt(seen)) / alpha * weights[c]
                n[c] = seen + slope * slope
    model = toxicity.ftrl(rows, alpha, beta, l1, l2, epochs=3)
    wanted = {c: w for c in z if c != "bias" and (w := weight(c))}
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(wanted, rel=1e-4) and model.bias == pytest.approx(weight("bias"))
    assert 0 < len(wanted) < len(z)


def test_features_are_words_pairs_and_skips():
    one = toxicity.Features().of
    assert len(one("a b c d")) == 4 + 3 + 2 and len(one("a")) == 1 and not len(one(None)) and not len(one(" ! "))
    assert (one("A b") == one("a, b")).all() and set(one("x y").tolist()) < set(one("x y z").tolist())


def test_more_languages_than_fifty(spark, table):
    """Each has an alphabet of its own; none is dropped."""
    rows, draw = [], random.Random(1)
    for g in range(60):
        letters = [chr(0x4E00 + 20 * g + i) for i in range(20)]
        rows += [(len(rows) + i, " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(30)), f"l{g:02d}") for i in range(6)]
    docs = table(rows)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs, language_id.train(docs), ["doc_id"]).collect()}
    assert all(found[i] == lang for i, _, lang in rows)
