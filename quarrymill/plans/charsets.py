"""Classes of characters as byte expressions: ranges of code points become alternatives of byte ranges in each encoding."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

Ranges = list[tuple[int, int]]


class PatternError(ValueError):
    pass


_LAST, _SURROGATES = 0x10FFFF, (0xD800, 0xDFFF)
_ITEM = re.compile(r"\\x(?P<hex>[0-9A-Fa-f]{2})|\\u(?P<wide>[0-9A-Fa-f]{4})|\\(?P<named>[dDwWsS])|\\(?P<control>[nrtf])|\\(?P<raw>z)|\\(?P<quoted>[^A-Za-z0-9])|(?P<char>[^\\])", re.S)
_CONTROLS = {"n": "\n", "r": "\r", "t": "\t", "f": "\f"}
#: Named classes hold ASCII characters only, as they do outside of classes.
_NAMED = {"d": [(0x30, 0x39)], "w": [(0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)], "s": [(0x09, 0x0D), (0x20, 0x20)]}


def _merged(ranges: Iterable[tuple[int, int]]) -> Ranges:
    out: Ranges = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _others(ranges: Ranges) -> Ranges:
    edges = [-1, *[x for r in _merged(ranges) for x in r], _LAST + 1]
    return [(a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2]) if a + 1 <= b - 1]


def ranges_of(text: str, nocase: bool) -> Ranges:
    """Code points of a class as it is written, brackets included."""
    negated = text.startswith("[^")
    body, at, items = text[2 if negated else 1 : -1], 0, []
    while at < len(body):
        m = _ITEM.match(body, at)
        if not m or m["raw"]:
            raise PatternError(f"class mixes characters beyond ASCII with what is none: {text}")
        if m["named"]:
            named = _NAMED[m["named"].lower()]
            items.append(named if m["named"].islower() else _others(named))
        else:
            items.append("-" if m["char"] == "-" else chr(int(m["hex"] or m["wide"], 16)) if m["hex"] or m["wide"] else _CONTROLS.get(m["control"]) or m["quoted"] or m["char"])
            if m["quoted"] == "-":
                items[-1] = [(0x2D, 0x2D)]
        at = m.end()
    ranges: Ranges = []
    i = 0
    while i < len(items):
        if isinstance(items[i], list):
            ranges += items[i]
        elif i + 2 < len(items) and items[i + 1] == "-" and isinstance(items[i + 2], str):
            if items[i] > items[i + 2]:
                raise PatternError(f"range {items[i]}-{items[i + 2]} runs backwards: {text}")
            ranges.append((ord(items[i]), ord(items[i + 2])))
            i += 2
        else:
            ranges.append((ord(items[i]),) * 2)
        i += 1
    ranges = _any_case(_merged(ranges)) if nocase else _merged(ranges)
    return _others(ranges) if negated else ranges


@lru_cache(maxsize=1)
def _cases() -> list[tuple[int, frozenset[int]]]:
    """Characters that have others of another case, with these: those whose lower or upper forms are the same single character."""
    lower: dict[str, set[int]] = {}
    forms: dict[int, set[str]] = {}
    for c in range(_LAST + 1):
        x = chr(c)
        if (kinds := {x.lower()[:1], x.upper(), x.upper().lower()}) != {x}:  # the one lower form of two characters is a letter with a dot above
            forms[c] = {k for k in (*kinds, x) if len(k) == 1}
            for k in forms[c]:
                lower.setdefault(k, set()).add(c)
    return [(c, frozenset().union(*[lower[k] for k in ks])) for c, ks in forms.items()]


def _any_case(ranges: Ranges) -> Ranges:
    more = [(o, o) for c, others in _cases() if any(a <= c <= b for a, b in ranges) for o in others]
    return _merged([*ranges, *more])


def _spans(low: bytes, high: bytes, least: bytes, most: bytes) -> Iterator[list[tuple[int, int]]]:
    """Texts of one length from low to high, in order, as products of byte ranges; bytes behind the first run from least to most."""
    if len(low) == 1 or low[0] == high[0] and low[1:] == least[1:] and high[1:] == most[1:]:
        yield [(low[0], high[0]), *zip(least[1:], most[1:])]
    elif low[0] == high[0]:
        for rest in _spans(low[1:], high[1:], least[1:], most[1:]):
            yield [(low[0], low[0]), *rest]
    else:
        first, last = low[0], high[0]
        if low[1:] != least[1:]:
            yield from _spans(low, low[:1] + most[1:], least, most)
            first += 1
        if high[1:] != most[1:]:
            last -= 1
        if first <= last:
            yield [(first, last), *zip(least[1:], most[1:])]
        if high[1:] != most[1:]:
            yield from _spans(high[:1] + least[1:], high, least, most)


def _clipped(ranges: Ranges, low: int, high: int) -> Ranges:
    return [(max(a, low), min(b, high)) for a, b in ranges if a <= high and b >= low]


# Code points by the number of bytes or units that they take in each encoding, and the bounds of the bytes behind the first.
_FORMS = {
    "utf-8": [(0, 0x7F, b"\0", b"\x7f"), (0x80, 0x7FF, b"\0\x80", b"\xff\xbf"), (0x800, 0xFFFF, b"\0\x80\x80", b"\xff\xbf\xbf"), (0x10000, _LAST, b"\0\x80\x80\x80", b"\xff\xbf\xbf\xbf")],
    "utf-16-be": [(0, 0xFFFF, b"\0\0", b"\xff\xff"), (0x10000, _LAST, b"\0\0\xdc\0", b"\xff\xff\xdf\xff")],
    "utf-32-be": [(0, _LAST, b"\0\0\0\0", b"\xff\xff\xff\xff")],
}
_SWAPPED = {"utf-16-le": ("utf-16-be", 2), "utf-32-le": ("utf-32-be", 4)}


def _bytes(low: int, high: int) -> str:
    return rf"\x{low:02x}" if low == high else rf"[\x{low:02x}-\x{high:02x}]"


def _set(values: Ranges) -> str:
    return "[" + "".join(rf"\x{a:02x}" + rf"-\x{b:02x}" * (b > a) for a, b in _merged(values)) + "]"


def class_in(text: str, codec: str, nocase: bool) -> str:
    """A byte expression for one character of a class in an encoding. Characters that the encoding cannot write are left out; PatternError if none is left."""
    ranges = ranges_of(text, nocase)
    codec = {"utf8": "utf-8", "utf_8": "utf-8"}.get(codec.lower(), codec)
    form, unit = _SWAPPED.get(codec, (codec, 1))
    if form not in _FORMS:
        return _in_single_bytes(ranges, codec, text)
    ones: Ranges = []
    forms: list[str] = []
    valid = [x for r in ranges for x in (*_clipped([r], 0, _SURROGATES[0] - 1), *_clipped([r], _SURROGATES[1] + 1, _LAST))]
    for low, high, least, most in _FORMS[form]:
        for a, b in _clipped(valid, low, high):
            for span in _spans(chr(a).encode(form), chr(b).encode(form), least, most):
                if len(span) == 1:
                    ones += span
                else:
                    placed = [x for i in range(0, len(span), unit) for x in reversed(span[i : i + unit])]
                    forms.append("".join(_bytes(*x) for x in placed))
    if ones:
        forms.insert(0, _set(ones))
    if not forms:
        raise PatternError(f"class without characters: {text}")
    # No character's bytes begin another's, so once a form has matched no other can: the group is atomic.
    return forms[0] if len(forms) == 1 and ones else f"(?>{'|'.join(forms)})"


def _in_single_bytes(ranges: Ranges, codec: str, text: str) -> str:
    try:
        known = [(b, bytes([b]).decode(codec, "replace")) for b in range(256)]
        single = len("é".encode(codec, "replace")) == 1 and len("A".encode(codec)) == 1
    except LookupError as error:
        raise PatternError(f"unknown encoding {codec}") from error
    found = [(b, b) for b, x in known if len(x) == 1 and x != "\ufffd" and any(low <= ord(x) <= high for low, high in ranges)]
    if not single or not found:
        raise PatternError(f"class cannot be written in {codec}: {text}")
    return _set(found)
