from __future__ import annotations

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.plans.analysis import bytes_beyond_ascii, factors, heads, least_size
from quarrymill.plans.compiler import hit_ends
from quarrymill.plans.patterns import PatternError, byte_regex
from quarrymill.plans.ruletext import Pattern

atoms = st.sampled_from(["a", "b", "C", "[ab]", "[aA]", "[^a]", ".", r"\d", r"\b", r"\B", "^", "$", r"\x00", "é"])
regexes = st.recursive(
    atoms,
    lambda x: st.one_of(
        st.lists(x, min_size=1, max_size=4).map("".join), st.tuples(x, x).map(lambda p: f"(?:{p[0]}|{p[1]})"), st.tuples(x, st.sampled_from(["*", "+", "?", "{2}", "{0,2}", "{1,3}", "+?"])).map(lambda p: f"(?:{p[0]}){p[1]}")
    ),
    max_leaves=8,
)
texts = st.text("abAC1 \n\x00\xe9", max_size=14)


@settings(max_examples=400, deadline=None)
@given(regexes, texts)
def test_what_is_said_of_hits_holds(regex, text):
    least, held = least_size(regex), factors(regex)
    first = {n: heads(regex, n) for n in (1, 2, 3)}
    for m in re.finditer(regex.encode("latin-1"), text.encode("latin-1"), re.S):
        hit = m[0]
        assert len(hit) >= least
        assert not held or any(f in hit.lower().decode("latin-1") for f in held)
        for n, wanted in first.items():
            assert wanted is None or hit[:n] in wanted


def test_some_of_what_is_said():
    assert factors("th[a-z]+") == ["th"] and factors("(?:foo|BARN)x?") == ["barn", "foo"] and factors("[0-9]+") == list("0123456789")
    assert factors("(?:ab)+cde") == ["cde"] and factors("a?[^b]") == [] and factors("[hH][eE][lL]p") == ["help"]
    assert heads("PK\\x03", 2) == {b"PK"} and heads("(?:GIF|BM)8?", 2) == {b"GI", b"BM"} and heads(".a", 1) is None and heads("ab?", 2) is None
    assert factors("(?:[lL]\\x00)(?:[iI]\\x00)") == ["l\x00i\x00"]


@settings(max_examples=400, deadline=None)
@given(regexes, texts)
def test_no_pattern_has_empty_hits(regex, text):
    """Patterns are refused, or their hits have a byte at least."""
    try:
        found = byte_regex(Pattern(regex, encodings=("ISO-8859-1",)))
    except PatternError:
        return
    assert all(m[0] for m in re.finditer(found.encode("latin-1"), text.encode("latin-1"), re.S))


@pytest.mark.parametrize("text", [r"\b", r"\B", "(a|\\b)", "a*", "(a?b?)", "^", "$", "(a|b*)"])
def test_refused(text):
    with pytest.raises(PatternError, match="can match nothing"):
        byte_regex(Pattern(text))


def test_bytes_beyond_ascii():
    assert bytes_beyond_ascii(r"[a-z]*\xc3[\xa0-\xaf]") == {0xC3} and bytes_beyond_ascii(r"(?>\xc3[\x80-\x8f]|\xe2\x84\xab){1,2}x") == {0xC3, 0xE2}
    assert bytes_beyond_ascii(r"[a-z]+") is None and bytes_beyond_ascii(r"a|\xc3") is None and bytes_beyond_ascii(r"\xc3*a") is None and bytes_beyond_ascii(r"[^a]") is None


@pytest.mark.parametrize("text", ["[a-z]*[à-ï]{1,2}x", "[a-z]+[à-ï]?x", "[0-9]*x", "[0-9a-z]*x", "[a-z]*[à-ïk]", "[a-z]*\\d", "(?:[0-9]*|[a-z]+x)y", "[^a-zà-ÿ]{2}[é-ë]", "[0-9]*x*y"])
def test_repeats_that_are_not_tried_again(text):
    """Hits are those of Python's re on the text, whatever repeat takes all that it can and whatever class is one group."""
    draw = random.Random(3)
    ours, plain = re.compile(byte_regex(Pattern(text, encodings=("UTF-8",))).encode("latin-1"), re.S), re.compile(text)
    for _ in range(300):
        t = "".join(draw.choice("ax0yéëàk. ") for _ in range(30))
        assert [m[0].decode() for m in ours.finditer(t.encode())] == [m[0] for m in plain.finditer(t)]


def test_ends_of_many_hits(spark):
    """One size more or less than a power of two, and far more hits than a row of text usually has."""
    for n in (0, 1, 2, 3, 4, 5, 7, 8, 9, 1_023, 1_025, 50_000):
        row = spark.range(1).select(F.transform(F.slice(F.sequence(F.lit(0), F.lit(n)), 2, n), lambda i: F.struct((i % 5).cast("int").alias("gap"), (i % 3 + 1).cast("int").alias("size"))).alias("hits"))
        sums = list(itertools.accumulate(i % 5 + i % 3 + 1 for i in range(1, n + 1)))
        assert row.select(hit_ends(F.col("hits"))).first()[0] == sums
