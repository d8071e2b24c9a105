from __future__ import annotations

import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.operators.search import search_hits
from quarrymill.plans.charsets import class_in, ranges_of
from quarrymill.plans.patterns import PatternError, byte_regex
from quarrymill.plans.ruletext import Pattern, read_rules

# Characters whose units cannot be read across the edge of two of them as others of the classes below.
LETTERS = "aZ9 -éÉöÖàÀÿŸñßÅ\u212bωΩжЖ中文\U0001f600\U00010400\U00010428"
ENCODINGS = ["UTF-8", "UTF-16LE", "UTF-16BE", "UTF-32LE"]
CODEC = {"UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "UTF-32LE": "utf-32-le"}


@pytest.mark.parametrize("nocase", [False, True])
@pytest.mark.parametrize("encoding", ENCODINGS)
@pytest.mark.parametrize("text", ["[à-ö]", "[^à-öa]", "[a-zà-öŸ\\d]", "[Ж-ж中]", "[\U0001f5ff-\U0001f6ff€]", "[\\u00e0-ö\\-]", "[\U00010428é]", "[à\\W]", "[-é]", "[é-]"])
def test_every_character_is_as_in_python(text, encoding, nocase):
    ours = re.compile(class_in(text, CODEC[encoding], nocase).encode("latin-1"), re.S)
    theirs = re.compile(text, re.I if nocase else 0)
    ascii_only = any(x in text for x in ("\\d", "\\W"))
    for c in [*range(0x3000), *range(0x4E00, 0x4E40), *range(0xD000, 0xD800), *range(0xE000, 0xE100), *range(0xFF00, 0x10500), *range(0x1F5F0, 0x1F710), sys.maxunicode]:
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        wanted = bool(theirs.fullmatch(x)) if not ascii_only else bool(re.compile(text.replace("\\d", "0-9").replace("\\W", "\\x00-/:-@[-^`{-\U0010ffff"), theirs.flags).fullmatch(x))
        assert bool(ours.fullmatch(x.encode(CODEC[encoding]))) == wanted, (x, hex(c))


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=12), st.sampled_from(["[à-ö]+", "x?[é中]{2}", "[à-öω]+|Ж"]), st.booleans(), st.sampled_from(["UTF-8", "UTF-16LE"]))
def test_hits_in_texts(text, regex, nocase, encoding):
    codec = CODEC[encoding]
    found = [m.span() for m in re.finditer(byte_regex(Pattern(regex, nocase=nocase, encodings=(encoding,))).encode("latin-1"), text.encode(codec), re.S)]
    wanted = [(len(text[: m.start()].encode(codec)), len(text[: m.end()].encode(codec))) for m in re.finditer(regex, text, re.I if nocase else 0)]
    assert found == wanted


def test_other_encodings_and_faults():
    assert ranges_of("[ä-ü]", False) == [(0xE4, 0xFC)]
    assert class_in("[ä-ü]", "latin1", False) == r"[\xe4-\xfc]" and class_in("[Ж-Я]", "koi8-r", False).startswith("[")
    for text, codec in (("[ж]", "latin1"), ("[é\\z80]", "utf-8"), ("[ö-à]", "utf-8"), ("[é]", "shift-jis"), ("[é]", "no-such")):
        with pytest.raises(PatternError):
            class_in(text, codec, False)


def test_search(spark):
    text = "Ärger, ÜBER älter 中文 naïve"
    files = spark.createDataFrame([(1, text.encode() + b"\0" * 2 + text.encode("utf-16-le"))], "Addr long, content binary").selectExpr("'/x' AS Path", "'n' AS Name", "*")
    rules = read_rules('rule r { grep: patterns: p = "[à-ü]+[a-z]" nocase encodings=UTF-8,UTF-16LE condition: any() }').rules
    hits = sorted((r.start_offset, r.end_offset) for r in search_hits(files, rules).collect())
    raw = text.encode() + b"\0" * 2
    at = lambda m, codec, base: (base + len(text[: m.start()].encode(codec)), base + len(text[: m.end()].encode(codec)))
    both = [at(m, c, b) for c, b in (("utf-8", 0), ("utf-16-le", len(raw))) for m in re.finditer("[à-ü]+[a-z]", text, re.I)]
    assert hits == sorted(both) and len(hits) == 8
