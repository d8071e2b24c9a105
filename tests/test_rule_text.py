from __future__ import annotations

import random

import pytest

from quarrymill.functions.blake3 import blake3_hex, record_id
from quarrymill.functions.blake3_lanes import LANES, blake3_each
from quarrymill.functions.content import digest, fuzzy_digest
from quarrymill.plans.ruletext import Both, Call, Either, Pattern, Property, read_rules, tokens_of


def errors(text):
    return [str(e) for e in read_rules(text).errors]


def one(text):
    found = read_rules(text)
    assert not found.errors, [str(e) for e in found.errors]
    return found.rules[0]


# Published digests of the bytes 0, 1, ... 250, 0, 1, ... of these lengths.
BLAKE3 = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
}


@pytest.mark.parametrize("size", BLAKE3)
def test_digests(size):
    assert blake3_hex(bytes(i % 251 for i in range(size))) == BLAKE3[size]


def test_digests_of_many():
    counting = bytes(i % 251 for i in range(8 * 1024 + 1))
    assert blake3_each([counting[:n] for n in BLAKE3]) == list(BLAKE3.values()) and blake3_each([]) == []
    sizes = [0, 63, 64, 65, 3072, 3073, 5 * 1024, 7 * 1024 + 5, 8 * 1024, 8 * 1024 + 1]
    assert blake3_each([counting[:n] for n in sizes]) == [blake3_hex(counting[:n]) for n in sizes]
    longer = counting * 515  # more chunks than are compressed together, behind other contents
    assert len(longer) > LANES * 1024 and blake3_each([b"x", longer, b""])[1] == blake3_hex(longer)


def test_digest_column_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, b"\x00"), (2, None), (3, b"")], "n int, content binary").coalesce(1)
    found = {r.n: (r.b, r.s) for r in rows.select("n", digest("blake3", "content").alias("b"), digest("ssdeep", "content").alias("s")).collect()}
    assert found == {1: (BLAKE3[1], fuzzy_digest(b"\x00")), 2: (None, None), 3: (BLAKE3[0], fuzzy_digest(b""))}


def test_identities():
    """Text ends with NUL, numbers are 64-bit little-endian."""
    assert record_id("x/y", "y", "", 7, 258) == blake3_hex(b"x/y\0y\0\0" + bytes([7, 0, 0, 0, 0, 0, 0, 0]) + bytes([2, 1, 0, 0, 0, 0, 0, 0]))


def ended(data, block):
    """Pieces before the tail, counted apart from the library: places where the rolling value of seven bytes says so."""
    count, mask = 0, 0xFFFFFFFF
    for i in range(len(data)):
        last = data[max(0, i - 6) : i + 1]
        third = 0
        for c in data[max(0, i - 6) : i + 1]:
            third = (third << 5 & mask) ^ c
        total = sum(last) + sum((7 - k) * c for k, c in enumerate(reversed(last))) + third
        count += (total & mask) % block == block - 1
    return min(count, 63)


@pytest.mark.parametrize("seed", range(12))
def test_block_sizes_of_fuzzy_digests(seed):
    """The block size is the largest from the one for the length down that ends 32 pieces before the tail."""
    draw = random.Random(seed)
    data = bytes(draw.choice(b"abcdefgh \n") for _ in range(draw.randrange(400, 6_000)))
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and ended(data, block) < 32:
        block //= 2
    assert fuzzy_digest(data).split(":")[0] == str(block)
    assert fuzzy_digest(b"") == "3::"


def test_rule_id_leaves_out_name_and_meta():
    a = one('rule a { meta: x = "1" file_metadata: filesize > 1 }')
    b = one("rule b { file_metadata: filesize > 1 }")
    assert a.id == b.id != one("rule c { file_metadata: filesize > 2 }").id
    assert one("rule d {}").id == one('rule e { meta: y = "z" }').id == blake3_hex(b"")


def test_sections():
    r = one(
        """rule R { meta: a = "b" a = "c" hash: md5 == "aa", sha1 == "bb"
        blake3 == "cc"
        file_metadata: created > "2023" and (filesize <= 5 or filename != "x")
        signature: name == "Executable" or id == "7"
        grep: patterns: s1 = "foo\\"bar" fixed nocase encodings=UTF-8,UTF-16LE s2 = { 12 3Ab4 } s1 = "other"
        condition: any(s1, s2) and count(s1) = 4 or length(s2, 1) >= 3 }"""
    )
    assert r.meta == {"a": "b"}
    assert r.hashes == [{"md5": "aa", "sha1": "bb"}, {"blake3": "cc"}]
    assert r.metadata == Both(Property("created", ">", "2023"), Either(Property("filesize", "<=", 5), Property("filename", "!=", "x")))
    assert r.signature == Either(Property("name", "==", "Executable"), Property("id", "==", "7"))
    assert r.patterns == {"s1": Pattern('foo\\"bar', True, True, ("UTF-8", "UTF-16LE")), "s2": Pattern(r"\z12\z3A\zb4")}
    assert r.condition == Either(Both(Call("any", ("s1", "s2")), Call("count", ("s1",), "==", 4)), Call("length", ("s2", "1"), ">=", 3))


@pytest.mark.parametrize(
    ("text", "names", "said"),
    [
        ("rule half }", [], ["Expected open brace at line 1 column 11", "Unexpected token } at line 1 column 11"]),
        (
            "rule half } rule open { rule whole {} rule last {", ["whole"],
            ["Expected open brace at line 1 column 11", "Unexpected token } at line 1 column 11", "Expected close brace at line 1 column 25", "Expected close brace at line 1 column 50"],
        ),
        ("rule odd { ; } rule fine {}", ["fine"], ["Expected close brace at line 1 column 12", "Unexpected token ; at line 1 column 12"]),
        (
            'rule bare { grep: patterns: condition: any() } rule fine { grep: patterns: z = "q" condition: any() }', ["fine"],
            ["No patterns specified at line 1 column 29", "Unexpected token condition at line 1 column 29"],
        ),
        ("rule one {} ; rule two {}", ["one", "two"], ["Unexpected token ; at line 1 column 13"]),
        ("rule quiet {/* } rule lost {}", [], ["Unterminated multi-line comment at line 1 column 13", "Expected close brace at line 1 column 30"]),
        ("; meta ( 5", [], ["Unexpected token ; at line 1 column 1"]),
        ("rule one {} ; meta ( 5", ["one"], ["Unexpected token ; at line 1 column 13"]),
        ("; meta ( 5 rule one {}", ["one"], ["Unexpected token ; at line 1 column 1"]),
    ],
)
def test_recovery(text, names, said):
    found = read_rules(text)
    assert [r.name for r in found.rules] == names
    assert [str(e) for e in found.errors] == said


@pytest.mark.parametrize(
    ("body", "said"),
    [
        ("hash:", "No hash algorithms specified"),
        ('hash: md5 == "a", md5 == "b"', "Duplicate hash type"),
        ('hash: md5 = "a"', "Expected equality operator"),
        ("file_metadata: filesize == \"1\"", "Unsupported type for right operand"),
        ("file_metadata: filename > \"1\"", "Unsupported operator for property"),
        ("file_metadata: any()", "Unexpected property name in section"),
        ("grep: condition: any()", "Expected patterns keyword"),
        ("grep: patterns: a = { 1 } condition: any()", "Odd number of hex digits"),
        ("grep: patterns: a = { } condition: any()", "Empty hex string"),
        ("grep: patterns: a = { zz } condition: any()", "Invalid hex digit"),
        ("grep: patterns: a = 5 condition: any()", "Expected double quoted string or hex string"),
        ('grep: patterns: a = "x" nocase fixed condition: any()', "Expected condition keyword"),
        ('grep: patterns: a = "x" condition: any() == 1', "Unexpected operator or value for function"),
        ('grep: patterns: a = "x" condition: count(a)', "Expected operator and value for comparison"),
        ('grep: patterns: a = "x" condition: count(a, a) > 1', "Invalid number of arguments"),
        ('grep: patterns: a = "x" condition: length() > 1', "Invalid number of arguments"),
        ('grep: patterns: a = "x" condition: a', "Expected function call or signature definition"),
    ],
)
def test_messages(body, said):
    assert errors(f"rule r {{ {body} }}")[0].startswith(said + " at line 1 column ")


def test_tokens():
    tokens, found = tokens_of('_x a-b_1 12 "q\\"r" // c\n/* d\n */ == = ! / "')
    assert [(t.kind, t.text) for t in tokens] == [
        ("other", "_"), ("identifier", "x"), ("identifier", "a-b_1"), ("number", "12"), ("string", 'q\\"r'), ("==", "=="), ("=", "="), ("end", ""),
    ]
    assert (tokens[5].line, tokens[5].column) == (3, 5)
    assert [str(e) for e in found] == [
        "Unexpected input character: ! at line 3 column 10", "Unexpected input character: / at  at line 3 column 12", "Unterminated string at line 3 column 14",
    ]
