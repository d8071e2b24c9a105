from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm.spelling import merge_trie, near_words, op12_spelling_variants, spelling_variants


def variants(word, letters):
    """All texts that one edit makes of a word."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}) - {word}


def near_by_brute_force(counts):
    letters = sorted({c for w in counts for c in w})
    out = {}
    for w in counts:
        near = [v for v in variants(w, letters) if v in counts]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (len(near), best, counts.get(best))
    return out


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abé", max_size=7), st.integers(1, 4), min_size=1, max_size=60))
def test_trie_against_brute_force(counts):
    words = sorted(counts)
    near, wanted = merge_trie(words, [counts[w] for w in words]), near_by_brute_force(counts)
    for i, w in enumerate(words):
        best = words[near.best[i]] if near.best[i] >= 0 else None
        assert (near.found[i], best) == wanted[w][:2]


@pytest.mark.parametrize("most", [1, 4, 40, 10_000])
def test_large_nodes_by_the_exchange(spark, most):
    draw = random.Random(most)
    counts = {"".join(draw.choice("abcÿ") for _ in range(draw.randrange(1, 9))): draw.randrange(1, 50) for _ in range(700)}
    # A beginning that a third of the words share.
    counts |= {"thesame" + w: n for w, n in list(counts.items())[:350]}
    found = near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), most).collect()
    assert {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in found} == {w: x for w, x in near_by_brute_force(counts).items() if x[0]}


def wanted_rows(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, near = {}, near_by_brute_force(counts)
    form = {w: f if f and m >= 5 * counts[w] else None for w, (_, f, m) in near.items()}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, near[w][0], counts[form[w]] if form[w] else None)
    return out


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_chains_of_forms(table):
    words = {"kitten": 1100, "kittens": 208, "kittenss": 40, "kittensss": 8, "kitton": 90, "sitten": 400, "other": 999, "otters": 4}
    rows = [(i, " ".join(w for w in words for _ in range(words[w] // 4))) for i in range(4)] + [(9, "otters " * 3 + "Kitten KITTEN kittén")]
    found = told(spelling_variants(table(rows)))
    assert found == wanted_rows(rows) and found["kittensss"][1] == "kitten" and found["sitten"][0] is None


def test_odd_and_no_documents(odd, none):
    assert told(spelling_variants(odd)) == wanted_rows([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert spelling_variants(none).count() == 0


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert told(op12_spelling_variants(spark, "/root/testdata/sf0.001")) == wanted_rows(rows)
