from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm.components import connected_components
from quarrymill.llm.near_copies import BITS, PARITIES, _sketch, keep_representatives, near_copies, radius, shingle_set, spanning_forest
from quarrymill.llm.simhash import bit_planes, close_pairs, fingerprint, op6_simhash_components, simhash_components


def brute_components(rows):
    """rows of (doc_id, 64-bit fingerprint): the smallest doc_id reachable over at most 2 differing bits."""
    left, out = set(range(len(rows))), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if (rows[i][1] ^ rows[j][1]).bit_count() <= 2}
            left -= near
            todo += near
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out |= dict.fromkeys(group, least)
    return [out[i] for i in range(len(rows))]


def test_fingerprint_is_what_spark_hashes(spark):
    text = "One two THREE\tfour\x0bfive é Six"
    words = text.replace("\t", " ").replace("\x0b", " ").split(" ")
    low = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
    shingles = [" ".join(low[i : i + 3]) for i in range(len(low) - 2)]
    hashes = [r[0] % (1 << 64) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    assert fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("A b") == spark.range(1).select(F.xxhash64(F.lit("a b"))).first()[0] % (1 << 64)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 300)), max_size=150))
def test_close_pairs(rows):
    rows = sorted(rows)
    values, run = np.array([v for _, v in rows], np.uint64), np.array([r for r, _ in rows], np.int64)
    planes = bit_planes(values.astype("<u2").view(np.uint8).reshape(-1, 2))
    found = {(a, b) for i, j, _ in close_pairs(planes, run) for a, b in zip(i.tolist(), j.tolist())} if rows else set()
    assert found == {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if run[i] == run[j] and (rows[i][1] ^ rows[j][1]).bit_count() <= 2}


def test_components_of_a_graph(spark):
    draw = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    draw.shuffle(chain)
    edges = chain + [(1000, 100 + i) for i in range(50)] + [(7, 7), (3000, 2999)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(41), 0) | dict.fromkeys([1000, *range(100, 150)], 100) | {3000: 2999, 2999: 2999}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in odd.collect()]
    found = sorted([(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_components(odd).collect()], key=repr)
    assert found == sorted([(*r, c) for r, c in zip(rows, brute_components(rows))], key=repr)
    assert simhash_components(none).count() == 0


def test_planted_near_fingerprints(spark, table, monkeypatch):
    """Many edits of a few texts, so that buckets hold many fingerprints."""
    draw, rows = random.Random(4), []
    for g in range(4):
        words = [draw.choice("abcdefghij") + str(draw.randrange(50)) for _ in range(3000)]
        for _ in range(40):
            copy = list(words)
            copy[draw.randrange(3000)] = "edit" + str(draw.randrange(999))
            rows.append((len(rows), " ".join(copy)))
    marked = [(i, fingerprint(t)) for i, t in rows]
    wanted = brute_components(marked)
    assert len(set(wanted)) < 60
    assert {r["doc_id"]: r["component_id"] for r in simhash_components(table(rows)).collect()} == {i: c for (i, _), c in zip(marked, wanted)}


def similarity(a, b):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 60))
def test_close_pairs_of_wide_fingerprints(seed, radius):
    draw = np.random.default_rng(seed)
    centre = draw.integers(0, 2, (3, 256))
    lanes = (centre[draw.integers(0, 3, 90)] ^ (draw.random((90, 256)) < 0.08)).astype(np.uint8)
    run = np.sort(draw.integers(0, 2, 90))
    pairs = close_pairs(bit_planes(np.packbits(lanes, axis=1, bitorder="little")), run, radius, 32)
    found = {(a, b): n for i, j, d in pairs for a, b, n in zip(i.tolist(), j.tolist(), d.tolist())}
    apart = {(i, j): int((lanes[i] ^ lanes[j]).sum()) for i in range(90) for j in range(i + 1, 90) if run[i] == run[j]}
    assert found == {k: n for k, n in apart.items() if n <= radius}


def test_near_copies_are_found_and_others_kept(table):
    draw, rows, family = random.Random(9), [], {}
    for g in range(60):
        words = [draw.choice("abcdefghijklmnop") + str(draw.randrange(900)) for _ in range(draw.choice([60, 200, 500]))]
        for c in range(1 if g % 2 else 5):
            copy = list(words)
            for _ in range(0 if c == 0 else max(1, len(copy) // 45)):
                copy[draw.randrange(len(copy))] = "edit" + str(draw.randrange(9999))
            family[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    found = {r["doc_id"]: r["component_id"] for r in near_copies(table(rows)).collect()}
    assert all(family[i] == family[c] for i, c in found.items())
    copies = [i for i in found if family[i] % 2 == 0 and i != min(j for j in family if family[j] == family[i])]
    best = {i: max(similarity(rows[i][1], rows[j][1]) for j in family if family[j] == family[i] and j < i) for i in copies}
    close = [i for i in copies if best[i] >= 0.8]
    assert len(close) > 50 and sum(found[i] != i for i in close) >= 0.95 * len(close)
    assert all(max(similarity(rows[i][1], rows[j][1]) for j in family if j != i and family[j] == family[i]) >= 0.8 for i in found if found[i] != i)


def test_a_large_group_of_near_copies(table):
    """Over one bucket's bound: the bucket is split on further bits, and the group still holds together."""
    draw = random.Random(6)
    words = [str(draw.randrange(10**6)) for _ in range(300)]
    rows = [(i, " ".join(words[: i % 300] + [f"e{i}"] + words[i % 300 + 1 :])) for i in range(1500)] + [(5000 + i, " ".join(str(draw.randrange(10**6)) for _ in range(50))) for i in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in near_copies(table(rows)).collect()}
    assert sum(found[i] == 0 for i in range(1500)) >= 1490
    assert all(found[5000 + i] == 5000 + i for i in range(20))


def parts(sketch):
    bits = np.unpackbits(np.frombuffer(sketch, np.uint8), bitorder="little")
    return bits[:BITS], bits[BITS:]


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 700), st.integers(0, 700), st.integers(0, 80))
def test_sketches_of_sets(seed, shared, more, others):
    """Parities bound the difference of two sets from below; a bit is set if over half of the single shingles have it."""
    draw = np.random.default_rng(seed)
    both, a, b = np.split(draw.integers(-(2**63), 2**63 - 1, shared + more + others), [shared, shared + more])
    x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
    assert (parts(_sketch(x))[1] != parts(_sketch(y))[1]).sum() <= more + others
    each = np.array([parts(_sketch(x[i : i + 1]))[0] for i in range(len(x))], int)
    assert (parts(_sketch(x))[0] == (2 * each.sum(0) > len(x))).all()
    assert np.bincount(x & (PARITIES - 1), minlength=PARITIES).sum() == len(x)


def test_fingerprints_of_near_copies_are_within_the_radius():
    draw = np.random.default_rng(1)
    for n, apart in ((4, 1), (9, 1), (45, 5), (450, 50)):
        for _ in range(200):
            x = draw.integers(-(2**63), 2**63 - 1, n + apart)
            a, b = (x[: n + apart // 2], np.concatenate([x[:n], x[n + apart // 2 :]])) if apart > 1 else (x[:n], x)
            assert (parts(_sketch(a))[0] != parts(_sketch(b))[0]).sum() < radius(0.8)


def test_a_spanning_forest_has_the_first_edges():
    draw = np.random.default_rng(2)
    for _ in range(30):
        i, j = draw.integers(0, 20, 60), draw.integers(0, 20, 60)
        label, kruskal = list(range(20)), []
        for k in range(60):
            if label[i[k]] != label[j[k]]:
                kruskal.append(k)
                label = [label[i[k]] if x == label[j[k]] else x for x in label]
        assert sorted(spanning_forest(20, i, j).tolist()) == kruskal


def test_sets_of_nothing():
    assert len(shingle_set(None)) == len(shingle_set(" \t")) == 1 and (shingle_set(None) == shingle_set("")).all()


def test_filter(odd, none):
    assert near_copies(none).count() == keep_representatives(none).count() == 0
    assert near_copies(odd).count() == odd.count()
    left = keep_representatives(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()).count(8) <= 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    found = op6_simhash_components(spark, f"/root/testdata/{sf}").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = [(i, fingerprint(t)) for i, t in texts.items()]
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows))}
