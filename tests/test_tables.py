from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.labels import META_FLAGS, flag_labels, format_timestamp
from quarrymill.operators.signatures import Check, Signature, bytes_of, identify, parse_offset, signature_faults, signature_of, significant_length
from quarrymill.operators.tables import full_paths, merge_ranges, unclaimed


@pytest.mark.parametrize(
    ("s", "ns", "shown"),
    [
        (0, 0, ""), (0, 1, "1970-01-01 00:00:00.000000001"), (1, 0, "1970-01-01 00:00:01"), (1_700_000_000, 700, "2023-11-14 22:13:20.0000007"),
        (86_399, 120_000_000, "1970-01-01 23:59:59.12"), (951_782_400, 0, "2000-02-29 00:00:00"), (-1, 5, "1969-12-31 23:59:59.000000005"), (5_000_000_000, 10**9, "2128-06-11 08:53:20"),
    ],
)
def test_timestamps(spark, s, ns, shown):
    assert spark.createDataFrame([(s, ns)], "s long, ns long").select(format_timestamp(F.col("s"), F.col("ns"))).first()[0] == shown


@pytest.mark.parametrize(
    ("s", "shown"),
    [
        (253_402_300_799, "9999-12-31 23:59:59"), (253_402_300_800, "10000-01-01 00:00:00"), (9_000_000_000_000, "287168-08-24 16:00:00"), (-62_135_596_800, "0001-01-01 00:00:00"),
        (-62_135_596_801, "0000-12-31 23:59:59"), (-200_000_000_000, "-4368-04-02 04:26:40"),
    ],
)
def test_timestamps_of_far_years(spark, s, shown):
    """As DuckDB's strftime writes them."""
    assert spark.createDataFrame([(s,)], "s long").select(format_timestamp(F.col("s"), F.lit(0))).first()[0] == shown


def test_flags(spark):
    rows = spark.createDataFrame([(0,), (5,), (63,)], "f int").select(flag_labels(F.col("f"), META_FLAGS)).collect()
    assert [r[0] for r in rows] == ["", "Allocated, Used", "Allocated, Deleted, Used, Unused, Compressed, Orphan"]


@pytest.mark.parametrize(("text", "value"), [("2", (2, True)), ("0x20", (32, True)), ("1062", (1062, True)), ("Z0x02", (-2, False)), ("Z5", (-5, False))])
def test_offsets(text, value):
    assert parse_offset(text) == value


# Lengths that rank patterns.
@pytest.mark.parametrize(
    ("pattern", "length"),
    [("RDP8bmp\\x00[\\x00-\\x10]\\x00{3}", 52), ("\\x00{12}\\xc2\\xea\\x81[\\x60\\x63\\x65\\x66\\x6a]", 68), ("[1-9]\\d* *\\n[\\x21-\\x39\\x3B-\\x7E]+:", 24), ("multiBit\\x2Einfo", 52)],
)
def test_pattern_lengths(pattern, length):
    assert significant_length(pattern) == length


def test_bytes():
    assert bytes_of("0x6D7A") == b"mz" and bytes_of("12") == b"\x0c"


def test_signatures(spark):
    known = [
        signature_of({"id": "zip", "name": "Archive", "pattern": "PK\\x03\\x04", "checks": [{"compare_type": "=", "offset": "0", "value": "0x504B0304"}], "extensions": {"ZIP": ""}}),
        signature_of({"id": "docx", "pattern": "PK\\x03\\x04.{4}word", "checks": [], "extensions": {"DOCX": ""}}),
        signature_of({"id": "bak", "checks": [{"compare_type": "=/c", "offset": "0x2", "value": "0x6162"}], "extensions": {"BAK": ""}}),
        signature_of({"id": "any", "checks": [{"compare_type": "=/c", "offset": "2", "value": "0x4142"}]}),
        signature_of({"id": "tail", "checks": [{"compare_type": "=", "offset": "Z0x02", "value": "0x2040", "pre_process": "0xFF20"}, {"compare_type": ">", "offset": "0", "value": "0x05"}]}),
        Signature("both", checks=(Check("NOR", 0, True, b"\x00"), Check("!", 1, True, b"\x00"), Check("OR", 1, True, b"\x00"), Check("^", 1, True, b"\x01"), Check("<", 1, True, b"\x05"))),
    ]
    rows = [
        (1, "a.zip", b"PK\x03\x04abcdWORD"), (2, "a.zip", b"PK\x03\x04abcdword.."), (3, "x.bak", b"..Ab"), (4, "x.txt", b"..aB"), (5, "x", b"\x09\x09 "), (6, "x", b""), (7, "x", b"zz"), (8, "x", b"\x00\x03\x00"),
    ]
    rows[4] = (5, "x", b"\x09\x20\x60")
    known[4] = signature_of({"id": "tail", "checks": [{"compare_type": "=", "offset": "Z0x02", "value": "0x2020", "pre_process": "0xFF20"}, {"compare_type": ">", "offset": "0", "value": "0x05"}]})
    found = identify(spark.createDataFrame(rows, "Addr long, Name string, content binary"), known)
    assert {r["Addr"]: (r["sig_id"], r["sig_stage"]) for r in found.collect()} == {
        1: ("zip", 1), 2: ("docx", 1), 3: ("bak", 2), 4: ("bak", 3), 5: ("tail", 3), 6: (None, None), 7: (None, None), 8: ("both", 3),
    }


def _one_by_one(rows, known):
    """Ranks files by trying every signature in turn."""
    compare = {
        "=": lambda a, b: a == b, "=/c": lambda a, b: bytes([a]).upper() == bytes([b]).upper(), "!": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b,
        "&": lambda a, b: a == b, "^": lambda a, b: a != 255 - b, "OR": lambda a, b: a | b != 0, "NOR": lambda a, b: a | b == 0,
    }

    def holds(c, data):
        at = c.offset if c.from_start else len(data) + c.offset
        if at < 0 or at + len(c.value) > len(data):
            return False
        masked = [x & (c.mask[i % len(c.mask)] if c.mask else 255) for i, x in enumerate(data[at : at + len(c.value)])]
        return all(compare[c.compare](a, b) for a, b in zip(masked, c.value))

    out = {}
    for addr, name, data in rows:
        ranked = [(1, s) for s in sorted(known, key=lambda s: -significant_length(s.pattern)) if s.pattern and re.match(s.pattern.encode(), data, re.S)]
        of = name.rpartition(".")[2].upper() if "." in name else None
        ranked += [(2, s) for s in [s for s in known if of in s.extensions][:1] if s.checks and all(holds(c, data) for c in s.checks)]
        ranked += [(3, s) for s in known if s.checks and all(holds(c, data) for c in s.checks)]
        out[addr] = (ranked[0][1].id, ranked[0][0]) if data and ranked else (None, None)
    return out


def test_hundreds_of_signatures_against_one_by_one(spark):
    draw = random.Random(8)
    byte = lambda: draw.choice(b"abAB\x00\xff.")
    known = []
    for i in range(900):
        pattern = "".join(draw.choice(["a", "b", "A", "B", "[ab]", "[^a]", ".", "\\x00", "(?:a|Bb)", "a{2}", "b?A"]) for _ in range(draw.randrange(2, 6))) if i % 3 else ""
        checks = [
            Check(draw.choice(["=", "=", "=", "=/c", "!", ">", "<", "&", "^", "OR", "NOR"]), *draw.choice([(0, True), (1, True), (4, True), (-2, False), (-5, False)]), bytes(byte() for _ in range(draw.randrange(1, 5))), draw.choice([b"", b"", b"\xdf", b"\xff\x0f"]))
            for _ in range(draw.randrange(1, 4))
        ]
        known.append(Signature(f"s{i}", pattern=pattern, checks=tuple(checks) if i % 2 else (), extensions=(f"E{i % 40}",)))
    known = [s for s in known if not s.pattern or not re.fullmatch(s.pattern.encode(), b"")]
    rows = [(i, f"f.e{draw.randrange(45)}" if i % 5 else "plain", bytes(byte() for _ in range(draw.randrange(0, 9)))) for i in range(300)]
    found = identify(spark.createDataFrame(rows, "Addr long, Name string, content binary"), known)
    assert {r["Addr"]: (r["sig_id"], r["sig_stage"]) for r in found.collect()} == _one_by_one(rows, known)


def test_patterns_that_cannot_be_read(spark):
    known = [Signature("bad", pattern="(", checks=(Check("=", 0, True, b"x"),)), Signature("empty", pattern="a*"), Signature("good", pattern="xy")]
    assert [str(e).split(":")[0] for e in signature_faults(known)] == ["signature bad", "signature empty"]
    found = identify(spark.createDataFrame([(1, "a", b"xy"), (2, "a", b"x")], "Addr long, Name string, content binary"), known).collect()
    assert [r["sig_id"] for r in found] == ["good", "bad"] and identify(spark.createDataFrame(found).select("Addr", "Name", "content"), []).where("sig_id IS NULL").count() == 2


def test_paths(spark):
    rows = [(1, None, "root"), (2, 1, "a"), (3, 2, "b"), (4, 3, "c"), (5, 4, "d"), (6, 99, "lost")]
    found = full_paths(spark.createDataFrame(rows, "MetaAddr long, ParentAddr long, Name string"))
    assert {r["MetaAddr"]: r["FullPath"] for r in found.collect()} == {1: "root", 2: "root/a", 3: "root/a/b", 4: "root/a/b/c", 5: "root/a/b/c/d", 6: "lost"}


def test_paths_of_links(spark):
    """Names of one file in several folders, one address in two file systems, a folder with two names, a root that is its own parent, names without metadata."""
    rows = [
        (0, 1, 1, "d"), (0, 2, 1, "d2"), (0, 3, 1, "d3"), (0, 9, 2, "h"), (0, 9, 3, "h2"), (0, 9, 3, "h3"), (64, 1, None, "other"), (64, 9, 1, "x"), (64, 2, 1, "y"), (64, 8, 2, "z"),
        (0, 4, 3, "b"), (0, 4, 2, "c"), (0, 5, 4, "below"), (0, None, 4, "gone"), (0, None, None, "nowhere"), (None, 1, None, "r"), (None, 2, 1, "s"),
    ]
    found = full_paths(spark.createDataFrame(rows, "FsOffset long, MetaAddr long, ParentAddr long, Name string"))
    assert found.columns == ["FsOffset", "MetaAddr", "ParentAddr", "Name", "FullPath"]
    assert sorted(((r["FsOffset"], r["FullPath"]) for r in found.collect()), key=repr) == sorted([
        (0, "d"), (0, "d/d2"), (0, "d/d3"), (0, "d/d2/h"), (0, "d/d3/h2"), (0, "d/d3/h3"), (64, "other"), (64, "other/x"), (64, "other/y"), (64, "other/y/z"),
        (0, "d/d3/b"), (0, "d/d2/c"), (0, "d/d2/c/below"), (0, "d/d2/c/gone"), (0, "nowhere"), (None, "r"), (None, "r/s"),
    ], key=repr)


def test_ranges_against_blocks(spark):
    draw = random.Random(5)
    live = [(draw.randrange(2), b := draw.randrange(60), b + draw.randrange(9)) for _ in range(12)]
    dead = [(draw.randrange(3), draw.randrange(5), b := draw.randrange(60), b + draw.randrange(1, 30)) for _ in range(20)]
    a, c = spark.createDataFrame(live, "fs int, begin long, end long"), spark.createDataFrame(dead, "fs int, inum int, begin long, end long")
    taken = {(f, x) for f, b, e in live for x in range(b, e)}
    assert {(r["fs"], x) for r in merge_ranges(a, ["fs"]).collect() for x in range(r["begin"], r["end"])} == taken
    wanted = {(f, i, x) for f, i, b, e in dead for x in range(b, e) if (f, x) not in taken}
    for stretch in (3, 7, 4096):
        merged = merge_ranges(a, ["fs"], stretch).collect()
        assert sorted((r["fs"], x) for r in merged for x in range(r["begin"], r["end"])) == sorted(taken)
        assert not any(r["fs"] == q["fs"] and r["begin"] == q["end"] for r in merged for q in merged)
        rows = unclaimed(c, a, ["fs"], stretch).collect()
        assert {(r["fs"], r["inum"], x) for r in rows for x in range(r["begin"], r["end"])} == wanted
        assert sum(r["end"] - r["begin"] for r in rows) == len(wanted)


def test_claims_across_cuts(spark):
    """Parts that run over many cuts, of stretches and of groups of stretches, are one; those on both sides of a block that is taken are two."""
    claims = [(0, 1, 5, 61), (0, 1, 60, 64), (0, 2, 0, 16), (0, 3, 16, 32), (1, 1, 3, 50), (None, 4, 7, 30), (0, 5, 9, 9)]
    a, c = spark.createDataFrame([(0, 24, 25), (0, 24, 25), (0, 33, 40), (1, 0, 3), (1, 48, 70)], "fs int, begin long, end long"), spark.createDataFrame(claims, "fs int, inum int, begin long, end long")
    for stretch, joined in ((4, 1), (4, 2), (8, 2), (5, 3), (256, 4096)):
        found = [tuple(r) for r in unclaimed(c, a, ["fs"], stretch, joined).select("fs", "inum", "begin", "end").collect()]
        assert sorted(found, key=repr) == sorted([(0, 1, 5, 24), (0, 1, 25, 33), (0, 1, 40, 64), (0, 2, 0, 16), (0, 3, 16, 24), (0, 3, 25, 32), (1, 1, 3, 48), (None, 4, 7, 30)], key=repr)


def test_parents_in_a_circle(spark):
    with pytest.raises(ValueError, match="circle"):
        full_paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "MetaAddr long, ParentAddr long, Name string"), 8)
