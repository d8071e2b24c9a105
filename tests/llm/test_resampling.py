from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quarrymill.llm.resampling import hashes, op13_crc_resampling, resample, words_in


def features(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def wanted_rows(docs, target, n, buckets, percent=10, least=20):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in features(text, n)[1]) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text, n)
        weight = sum(gain(bucket(x)) for x in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted([tuple(r[:5]) for r in rows], key=repr)


def told(df):
    return sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ring_hashes_every_run_of_words(n):
    draw = random.Random(n)
    for text in ["", "one", "Naïve CAFÉ 42 x", *["".join(draw.choice("aB1 é.-_\n ") for _ in range(draw.randrange(90))) for _ in range(200)]]:
        assert [w.decode() for w in words_in(text)] == features(text, n)[0]
        assert Counter(hashes(words_in(text), n)) == Counter(zlib.crc32(x.encode()) for x in features(text, n)[1])


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (3, 40), (2, 100)])
def test_against_brute_force(table, spark, n, percent):
    draw = random.Random(n)
    pick = lambda k: " ".join(draw.choice(["red", "green", "blue", "Grün", "x1", "y2", "zz"]) for _ in range(k))
    docs = [(i, pick(draw.randrange(60))) for i in range(300)] + [(500 + i, "the same words again " * 9) for i in range(150)]
    target = [pick(20) for _ in range(10)]
    found = resample(table(docs), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, percent=percent)
    assert told(found) == wanted_rows(docs, target, n, 97, percent)


def test_odd_and_no_documents(odd, none, spark):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = [None, "", "the cat sat"]
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    assert told(resample(odd, asked, n=2, percent=50)) == wanted_rows(docs, target, 2, 10_000, 50)
    assert resample(none, asked).count() == 0
    assert told(resample(odd, none, n=1)) == wanted_rows(docs, [], 1, 10_000)


def test_query_against_brute_force(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()
    docs, target = [(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")]
    assert told(op13_crc_resampling(spark, "/root/testdata/sf0.001")) == wanted_rows(docs, target, 1, 10_000)
