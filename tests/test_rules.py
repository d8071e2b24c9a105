from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.operators.rules import rule_hits
from quarrymill.operators.search import search_hits
from quarrymill.plans.patterns import PatternError, byte_regex, needed_texts
from quarrymill.plans.ruletext import Pattern, read_rules
from quarrymill.sources.config import keyword_rule, yara_pattern

FILES = [
    (1, "/a", "one.txt", 17, "2023-01-01 00:00:00", b"this is so foobar"),
    (2, "/a", "two.txt", 23, "2023-05-05 00:00:00", b"foo is foobar is foobaz"),
    (3, "/b", "it's", 0, "", b""),
    (4, "/b", "wide", 20, "2024-01-01 00:00:00", "xfoobaréy".encode("utf-16-le")),
    (5, "/c", "e", 6, "2024-01-01 00:00:00", "Ééfoo".encode()),
]
COLUMNS = "Addr long, Path string, Name string, Filesize long, Created string, content binary"


@pytest.fixture(scope="module")
def files(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(FILES, COLUMNS).withColumn("Modified", F.col("Created")).withColumn("sig_id", F.lit(None).cast("string")).withColumn("sig_name", F.lit("T"))


def matched(files, body, **more):
    found = read_rules(f"rule r {{ {body} }}")
    assert not found.errors
    return sorted(r["addr"] for r in rule_hits(files, found.rules, **more).collect())


@pytest.mark.parametrize(
    ("body", "addrs"),
    [
        ("", [1, 2, 3, 4, 5]),
        ('file_metadata: filename == "it\'s"', [3]),
        ("file_metadata: filesize >= 17 and filesize < 23 or filepath == \"/c\"", [1, 4, 5]),
        ('grep: patterns: a = "foo" b = "zz" condition: any()', [1, 2, 5]),
        ('grep: patterns: a = "foo" b = "zz" condition: all()', []),
        ('grep: patterns: a = "foo" b = "baz" condition: all()', [2]),
        ('grep: patterns: a = "foo" condition: count(a) == 0', [3, 4]),
        ('grep: patterns: a = "foo" condition: count(a) > 2', [2]),
        ('grep: patterns: a = "foo[a-z]*" condition: length(a) == 6', [1, 2]),
        ('grep: patterns: a = "foo[a-z]*" condition: length(a, 1) == 3', [2, 5]),
        ('grep: patterns: a = "foo" condition: offset(a) == 17', [2]),
        ('grep: patterns: a = "foo" condition: offset(a, 2) == 7', [2]),
        ('grep: patterns: a = "foo" condition: offset(a, 9) < 100', []),
        ('grep: patterns: a = "foo" b = "is" condition: count_has_hits() == 2', [1, 2]),
        ('grep: patterns: a = "foo" b = "is" condition: count_has_hits(b) < 1', [3, 4, 5]),
        ('grep: patterns: a = "foo" condition: any(nobody) or count(nobody) == 1', []),
        ('grep: patterns: a = "FOO" fixed nocase encodings=UTF-16LE condition: any()', [4]),
        ('grep: patterns: a = "FOO" fixed nocase encodings=UTF-8,UTF-16LE condition: any()', [1, 2, 4, 5]),
        ('grep: patterns: a = "é" fixed nocase condition: count(a) == 2', [5]),
        ('grep: patterns: a = { 66 6f 6f } condition: any()', [1, 2, 5]),
        ('hash: md5 == "D41D8CD98F00B204E9800998ECF8427E"', [3]),
        ('hash: md5 == "d41d8cd98f00b204e9800998ecf8427e", sha1 == "00"', []),
        ('hash: blake3 == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"\nsha1 == "00"', [3]),
        ('signature: name == "T"', [1, 2, 3, 4, 5]),
        ('signature: id == "T"', []),
    ],
)
def test_rules(files, body, addrs):
    assert matched(files, body) == addrs


def test_metadata_only(files):
    assert matched(files, 'file_metadata: filesize > 0 grep: patterns: a = "zz" condition: any()', metadata_only=True) == [1, 2, 4, 5]


def test_equal_rules_count_once(files):
    rules = read_rules("rule a { file_metadata: filesize > 20 } rule b { file_metadata: filesize > 20 }").rules
    assert rule_hits(files, rules).count() == 1
    assert rule_hits(files, []).count() == 0


def offsets(files, pattern, addr):
    rules = read_rules(f"rule r {{ grep: patterns: a = {pattern} condition: any() }}").rules
    return sorted((r["start_offset"], r["end_offset"]) for r in search_hits(files.where(f"Addr = {addr}"), rules).collect())


def test_hits(files):
    assert offsets(files, '"foobar"', 1) == [(11, 17)]
    assert offsets(files, '"foo"', 2) == [(0, 3), (7, 10), (17, 20)]
    assert offsets(files, '"foo"', 5) == [(4, 7)]
    assert offsets(files, '"foo" encodings=UTF-16LE', 4) == [(2, 8)]


def test_one_long_hit(spark):
    files = spark.createDataFrame([(1, bytearray(b"a" * (2**20 + 4)))], "Addr long, content binary")
    assert offsets(files, '"a+"', 1) == [(0, 2**20 + 4)]


def test_equal_contents_searched_once(spark):
    files = spark.createDataFrame([(i, bytearray(b"xay")) for i in range(5)], "Addr long, content binary")
    rules = read_rules('rule r { grep: patterns: a = "a" condition: any() }').rules
    assert search_hits(files, rules).count() == 5
    assert search_hits(files, rules, key=None).count() == 1


@pytest.mark.parametrize("text", ["a*", "(", "x|", "a{0,3}"])
def test_refused_patterns(text):
    with pytest.raises(PatternError):
        byte_regex(Pattern(text))


@settings(max_examples=60, deadline=None)
@given(st.text("abé.*+", min_size=1, max_size=5), st.text("abAéÉ.*+x", max_size=30), st.sampled_from(["UTF-8", "UTF-16LE", "ISO-8859-1"]))
def test_literals_are_found_where_they_stand(needle, hay, encoding):
    codec = {"UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "ISO-8859-1": "latin-1"}[encoding]
    regex = re.compile(byte_regex(Pattern(needle, fixed=True, encodings=(encoding,))).encode("latin-1"))
    wanted = re.compile(re.escape(needle.encode(codec)))
    assert [m.span() for m in regex.finditer(hay.encode(codec))] == [m.span() for m in wanted.finditer(hay.encode(codec))]


@pytest.mark.parametrize(
    ("text", "hay", "spans"),
    [
        ("{ 61 ?? 63 }", b"abc a\nc", [(0, 3), (4, 7)]), ("{ 6? 31 }", b"a1 o1 p1", [(0, 2), (3, 5)]), ("{ ?1 }", b"1aq", [(0, 1), (1, 2), (2, 3)]),
        ("{ 61 [1-2] 62 }", b"axb axxb axxxb", [(0, 3), (4, 8)]), ("{ 61 [2] 62 }", b"axb axxb", [(4, 8)]), ("{ 61 [-] 62 }", b"a..b", [(0, 4)]),
        ("{ 61 ( 62 63 | 64 ) 65 }", b"abce ade", [(0, 4), (5, 8)]),
    ],
)
def test_hexadecimal_strings(text, hay, spans):
    assert [m.span() for m in re.finditer(byte_regex(yara_pattern(text)).encode("latin-1"), hay, re.S)] == spans


@pytest.mark.parametrize("text", ["{ 6 }", "{ xy }", "{ 61 ( 62 }", "{ 61 ) }", "{ [] 61 }", "{ }"])
def test_hexadecimal_strings_that_cannot_be_read(text):
    with pytest.raises(PatternError):
        yara_pattern(text)


@settings(max_examples=60, deadline=None)
@given(st.text("aBé. ", min_size=1, max_size=6), st.booleans(), st.sampled_from(["UTF-8", "UTF-16LE"]), st.binary(max_size=5))
def test_hits_hold_the_texts_they_need(needle, nocase, encoding, around):
    pattern = Pattern(needle, True, nocase, (encoding,))
    codec = {"UTF-8": "utf-8", "UTF-16LE": "utf-16-le"}[encoding]
    for m in re.finditer(byte_regex(pattern).encode("latin-1"), around + needle.swapcase().encode(codec) + needle.encode(codec)):
        assert all(t in (m[0].lower() if nocase else m[0]) for t in needed_texts(pattern))


def test_offsets_of_very_many_hits(spark):
    data = bytes(97 + (i * i % 7) for i in range(5_000))
    files = spark.createDataFrame([(1, bytearray(data))], "Addr long, content binary")
    assert offsets(files, '"b+"', 1) == [m.span() for m in re.finditer(b"b+", data)]


def test_keywords_and_yara(spark, files, tmp_path):
    (tmp_path / "words").write_text("foobaz\n\nis so\n")
    assert sorted(r["addr"] for r in rule_hits(files, [keyword_rule([str(tmp_path / "words")])]).collect()) == [1, 2]
    assert byte_regex(yara_pattern("{ 4D 5a }")) == r"\x4d\x5a"
    assert byte_regex(yara_pattern("a.b", ("wide",))) == r"(?:\x61\x00)(?:\x2e\x00)(?:\x62\x00)"
