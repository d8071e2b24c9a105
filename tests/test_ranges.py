"""Hits found range by range are those of the whole file."""

from __future__ import annotations

import random
import re

import pytest

from quarrymill.operators.ranges import file_ranges, search_ranges
from quarrymill.operators.search import search_hits
from quarrymill.plans.ruletext import read_rules
from quarrymill.sources.files import directory_files

RULES = read_rules(r'''rule a { grep: patterns: run = "a+" pair = "aa" three = "aba" fixed some = "b[ab]{0,3}a" edge = "\bab+\b" head = "^[ab]" tail = "[ab]$" wide = "ab" fixed encodings=UTF-16LE,ASCII condition: any() }
rule b { grep: patterns: far = "c.{0,40}d" line = "c[^\n]*d" condition: any() }''').rules  # fmt: skip


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    draw, top = random.Random(3), tmp_path_factory.mktemp("large")
    (top / "below here%20").mkdir()
    texts = {"runs": b"a" * 333 + b"b" + b"a" * 500, "empty": b"", "one": b"a", "odd": b"ab" * 150 + b"a\n", "below here%20/mixed": "".join(draw.choice(["a", "ab", "b", "aaa", " ", "c", "d", "\n", "a\0b\0"]) for _ in range(900)).encode()}
    for i in range(6):
        texts[f"draw{i}"] = bytes(draw.choice(b"aab cd\n") for _ in range(draw.randrange(1, 700)))
    for name, data in texts.items():
        (top / name).write_bytes(data)
    return str(top), texts


@pytest.mark.parametrize(("size", "ahead"), [(7, 1), (64, 5), (100, 50), (1 << 20, 1 << 10)])
def test_against_whole_files(spark, folder, size, ahead):
    top, texts = folder
    found = [(r["path"].rpartition("large")[2].partition("/")[2], r["pattern_id"], r["nth"], r["start_offset"], r["end_offset"], r["length"]) for r in search_ranges(spark, top, RULES, size, ahead).collect()]
    whole = search_hits(directory_files(spark, top), RULES)
    names = {r["Addr"]: (r["Path"] + "/" + r["Name"]).rpartition("large")[2].partition("/")[2] for r in directory_files(spark, top).select("Addr", "Path", "Name").collect()}
    wanted = [(names[r["file"]], r["pattern_id"], r["nth"], r["start_offset"], r["end_offset"], r["length"]) for r in whole.collect()]
    # A hit that may go on over what was read ahead needs as much: the line's is told where ahead is long enough.
    told = lambda rows: sorted(x for x in rows if x[1] != "line" or ahead > 40)
    assert told(found) == told(wanted) and len(found) > 1_000
    assert {x[3:5] for x in found if x[:2] == ("runs", "run")} == {m.span() for m in re.finditer(b"a+", texts["runs"])}


def test_ranges(spark, folder):
    rows = [r for r in file_ranges(spark, folder[0], 100).collect() if r["path"].endswith("runs")]
    assert sorted((r["nth"], r["start"], r["end"]) for r in rows) == [(i, 100 * i, min(834, 100 * i + 100)) for i in range(9)]
    assert search_ranges(spark, folder[0], []).count() == 0
