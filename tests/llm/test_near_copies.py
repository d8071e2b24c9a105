"""Components of near copies against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

from quarrymill.llm.near_copies import near_copies, radius


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, similarity=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            shared = len(a & b)
            if shared >= similarity * (len(a) + len(b) - shared) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def told(table, rows, similarity=0.8):
    return {r["doc_id"]: r["component_id"] for r in near_copies(table(rows), similarity).collect()}


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.95, 1.0])
def test_other_similarities(table, similarity):
    draw, rows = random.Random(6), []
    for k in range(60):
        base = [f"w{draw.randrange(10**7)}" for _ in range(draw.choice([5, 7, 12, 60, 300]))]
        for _ in range(4):
            copy = list(base)
            for place in draw.sample(range(len(base)), min(len(base), draw.choice([0, 1, 1, 2, 5]) * max(1, len(base) // 60))):
                copy[place] = f"e{draw.randrange(10**7)}"
            rows.append((len(rows), " ".join(copy)))
    expected = brute(rows, similarity)
    assert 60 <= len(set(expected.values())) < 240
    assert told(table, rows, similarity) == expected


def test_radius():
    assert radius(0.8) == 84 and radius(1.0) == 0 and radius(0.3) < 256
    for wrong in (0, -1, 1.1):
        with pytest.raises(ValueError, match="similarity"):
            near_copies(None, wrong)


def test_pairs_among_texts_that_share_boilerplate(table):
    """More texts lean to the same bits than a full bucket holds; forty have one partner each, at 0.8 or little more."""
    draw = random.Random(3)
    common, rows = [f"c{i}" for i in range(170)], []
    for g in range(1_400):
        own = [f"w{draw.randrange(10**7)}" for _ in range(30)]
        rows.append((len(rows), " ".join(common + own)))
        if g % 35 == 0:
            copy = common + own
            for place in (20, 60, 100, 140):
                copy[place] = f"e{draw.randrange(10**7)}"
            rows.append((len(rows), " ".join(copy)))
    expected = brute(rows)
    assert sum(i != c for i, c in expected.items()) == 40
    assert told(table, rows) == expected


def test_families_at_the_edge_of_similarity(table):
    """The nearest text by fingerprint often fails and another one holds."""
    draw, rows = random.Random(4), []
    for _ in range(25):
        base = [f"w{draw.randrange(10**7)}" for _ in range(150)]
        for _ in range(14):
            copy = list(base)
            for place in draw.sample(range(150), draw.choice([2, 3, 3, 4])):
                copy[place] = f"e{draw.randrange(10**7)}"
            rows.append((len(rows), " ".join(copy)))
    expected = brute(rows)
    assert 60 < len(set(expected.values())) < 340
    assert told(table, rows) == expected


def test_repeated_words_and_short_texts(table):
    """One shingle is over half of all: the rest still counts. Distinct shingles count once. Four of five shingles are 0.8."""
    draw = random.Random(5)
    some = lambda n: " ".join(f"w{draw.randrange(10**7)}" for _ in range(n))
    rows = [(i, "spam " * 200 + some(12)) for i in range(6)]
    base = some(60)
    rows += [(10, base + " aa bb" * 300), (11, base + " aa bb" * 9), (12, base + " cc dd" * 300)]
    for i in range(20, 40, 2):
        words = some(9)
        rows += [(i, words), (i + 1, words.rsplit(" ", 1)[0])]
    expected = brute(rows)
    assert expected[5] == 5 and expected[11] == 10
    assert all(expected[i + 1] == i for i in range(20, 40, 2))
    assert told(table, rows) == expected
