"""Search patterns as regular expressions over bytes (text with one character per byte).

Supported: literals, classes, groups, alternation, quantifiers, `.`, anchors, the escapes of Java and Python that both know, and \\zHH for a raw byte.
Classes with characters beyond ASCII are sets of characters, spelled out in each encoding (charsets.py); others are sets of bytes.
Patterns that can match nothing are refused: hits have at least one byte.
"""

from __future__ import annotations

import re
from functools import lru_cache

from quarrymill.plans.analysis import heads
from quarrymill.plans.charsets import PatternError, class_in
from quarrymill.plans.ruletext import Pattern

#: Names of encodings to names of codecs; others are looked up as they are.
CODECS = {"ASCII": "utf-8", "UTF-8": "utf-8", "UTF8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "UTF-32LE": "utf-32-le", "ISO-8859-1": "latin-1"}
DEFAULT = ("ASCII",)
_ATOM = re.compile(
    r"""\\[zx](?P<byte>[0-9A-Fa-f]{2})|(?P<escape>\\[dDwWsS])|(?P<edge>\\[bB]|\^|\$)|\\(?P<control>[nrtf])|\\(?P<quoted>.)|(?P<set>\[(?:\\.|[^\]\\])+\])
    |(?P<group>\(\?:|\(|\)|\|)|(?P<many>[*+?]\??|\{\d+(?:,\d*)?\}\??)|(?P<dot>\.)|(?P<char>.)""",
    re.X | re.S,
)


def _literal(char: str, codec: str, nocase: bool) -> str:
    forms = dict.fromkeys([char, *((char.lower(), char.upper()) if nocase else ())])
    try:
        spelled = dict.fromkeys("".join(rf"\x{b:02x}" for b in f.encode(codec)) for f in forms)
    except (UnicodeEncodeError, LookupError) as error:
        raise PatternError(f"cannot encode {char!r} in {codec}") from error
    if len(spelled) == 1:
        return next(iter(spelled))
    return f"[{''.join(spelled)}]" if all(len(x) == 4 for x in spelled) else f"(?:{'|'.join(spelled)})"


def _one_byte(atom: str, codec: str) -> str:
    """An atom that stands for one ASCII character, in a codec of wider units."""
    pads = {"utf-16-le": ("", r"\x00"), "utf-16-be": (r"\x00", ""), "utf-32-le": ("", r"\x00\x00\x00")}.get(codec, ("", ""))
    return atom if pads == ("", "") else f"(?:{pads[0]}{atom}{pads[1]})"


def _many(piece: str) -> str:
    """A piece in the form that a quantifier takes whole."""
    return f"(?:{piece})" if not piece.startswith("[") and len(re.findall(r"\\x..", piece)) > 1 and not piece.startswith("(?:") else piece


def _in_encoding(pattern: Pattern, encoding: str) -> str:
    codec = CODECS.get(encoding.upper(), encoding)
    if pattern.fixed:
        return "".join(_literal(c, codec, pattern.nocase) for c in pattern.text)
    out, kinds = [], []
    for m in _ATOM.finditer(pattern.text):
        kinds.append(m.lastgroup)
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "byte":
            out.append(rf"\x{text.lower()}")
        elif kind == "control":
            out.append(_many(_literal({"n": "\n", "r": "\r", "t": "\t", "f": "\f"}[text], codec, False)))
        elif kind in ("quoted", "char"):
            out.append(_many(_literal(text, codec, pattern.nocase)))
        elif kind == "escape":
            out.append(_one_byte(text, codec))
        elif kind == "set":
            if not text.isascii():
                out.append(class_in(text, codec, pattern.nocase))
                continue
            text = text.replace(r"\z", r"\x")
            both = text[:-1] + re.sub(r"\\.|[a-zA-Z]-[a-zA-Z]|[a-zA-Z]", lambda c: c[0] if c[0][0] == "\\" else c[0].swapcase(), text[1 + (text[1] == "^") : -1]) + "]"
            out.append(_one_byte(both if pattern.nocase else text, codec))
        elif kind == "dot":
            out.append(_one_byte(r"[^\n]", codec))
        elif kind == "group":
            out.append("(?:" if text == "(" else text)
        else:
            out.append(text)
    for i in range(1, len(out) - 1):
        if out[i] in ("*", "+") and _ends_before(out[i - 1], out[i + 1], kinds[i + 1], out[i + 2] if out[i + 2 :] else ""):
            out[i] += "+"
    return "".join(out)


def _ends_before(repeated: str, next_: str, kind: str, behind: str) -> bool:
    """Whether a repeated class always takes all that it can, since what follows it must be there and begins with none of its bytes: then nothing is to be tried again with less."""
    if not repeated.startswith("[") or kind not in ("set", "char", "byte", "quoted") or behind[:1] in ("*", "?") or behind.startswith("{0"):
        return False
    own, follow = heads(repeated, 1), heads(next_, 1)
    return own is not None and follow is not None and not own & follow


@lru_cache(maxsize=1 << 16)
def byte_regex(pattern: Pattern) -> str:
    """One expression for all encodings of a pattern; where several match, the first named one counts."""
    forms = list(dict.fromkeys(_in_encoding(pattern, e) for e in pattern.encodings or DEFAULT))
    joined = forms[0] if len(forms) == 1 else "|".join(f"(?:{f})" for f in forms)
    try:
        # The least width of the parsed pattern, since edges of words and the like are nothing too, wherever they stand.
        least = re._parser.parse(joined.encode("latin-1"), re.S).getwidth()[0]
        re.compile(joined.encode("latin-1"))
    except (re.error, RecursionError, OverflowError) as error:
        raise PatternError(f"cannot read pattern {pattern.text!r}: {error}") from error
    if least == 0:
        raise PatternError(f"pattern {pattern.text!r} can match nothing")
    return joined


def needed_texts(pattern: Pattern) -> list[bytes]:
    """Texts of which every hit holds one at least, a text for each encoding, ASCII letters in lower case if the pattern ignores case; none if nothing can be said.

    They are taken from patterns without groups, alternatives and counts: the longest run of plain characters.
    """
    text = pattern.text
    if pattern.fixed:
        runs = [text]
    elif any(m.lastgroup in ("group", "many", "edge") for m in _ATOM.finditer(text)):
        return []
    else:
        runs = "".join(m[0] if m.lastgroup == "char" else "\0" for m in _ATOM.finditer(text)).split("\0")
    longest = max(runs, key=len)
    if len(longest) < 3 or pattern.nocase and not longest.isascii():
        return []
    longest = longest.lower() if pattern.nocase else longest
    return list(dict.fromkeys(longest.encode(CODECS.get(e.upper(), e)) for e in pattern.encodings or DEFAULT))
