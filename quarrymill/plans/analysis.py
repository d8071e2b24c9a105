"""What can be said of a byte expression before it is searched: the least size of a hit, the bytes that hits begin with, and texts that hits hold."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from quarrymill.plans.charsets import PatternError

#: Texts that a stretch of characters may be spelled out to, and characters of a class that are spelled out.
_MOST_TEXTS, _MOST_CHARS = 64, 16
_parser = re._parser  # the tree that re compiles from
_REPEATS = (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT)


def tree_of(regex: str) -> Sequence:
    try:
        return _parser.parse(regex.encode("latin-1"), re.S)
    except (re.error, RecursionError, OverflowError) as error:
        raise PatternError(f"cannot read expression {regex!r}: {error}") from error


def least_size(regex: str) -> int:
    """Bytes of the shortest hit."""
    return tree_of(regex).getwidth()[0]


def _class(items: Iterable) -> set[int] | None:
    """Bytes of a class; None if it is negated or holds classes by name."""
    out: set[int] = set()
    for op, value in items:
        if op is _parser.LITERAL:
            out.add(value)
        elif op is _parser.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            return None
    return out


def _byte(op: object, value: object) -> set[int] | None:
    if op is _parser.LITERAL:
        return {value}
    return _class(value) if op is _parser.IN else None


def heads(regex: str, size: int) -> set[bytes] | None:
    """The first `size` bytes of every possible hit; None if there are too many, or hits may be shorter."""

    def spell(items: Sequence, found: set[bytes]) -> set[bytes] | None:
        """found with what items add, as long as needed; None if it cannot be said. Texts of full size are done."""
        for op, value in items:
            if all(len(x) >= size for x in found):
                return found
            if (chars := _byte(op, value)) is not None:
                found = {x + bytes([c]) if len(x) < size else x for x in found for c in chars}
            elif op is _parser.SUBPATTERN:
                found = spell(value[3], found)
            elif op is _parser.ATOMIC_GROUP:
                found = spell(value, found)
            elif op is _parser.BRANCH:
                parts = [spell(x, found) for x in value[1]]
                found = None if None in parts else set().union(*parts)
            elif op in _REPEATS:
                low, high, body = value
                for _ in range(min(low, size)):
                    found = found and spell(body, found)
                # What is not asked for may be there or not: only texts that are long enough by now are certain.
                if found is not None and high != low and any(len(x) < size for x in found):
                    found = None
            else:
                found = None
            if found is None or len(found) > _MOST_TEXTS:
                return None
        return found

    out = spell(tree_of(regex), {b""})
    return out if out is not None and all(len(x) >= size for x in out) else None


def factors(regex: str) -> list[str]:
    """Texts in lower case (one character per byte, ASCII letters only folded) of which every hit, lower-cased, holds one at least; the longest such set, none if nothing can be said."""
    return sorted(_factors(tree_of(regex)) or ())


def _worth(texts: set[str]) -> tuple[int, int]:
    return min(map(len, texts)), -len(texts)


def _factors(items: Sequence) -> set[str] | None:
    best: set[str] | None = None
    run = {""}

    def offer(texts: set[str] | None) -> None:
        nonlocal best
        if texts and all(texts) and (best is None or _worth(texts) > _worth(best)):
            best = texts

    def take(items: Sequence) -> None:
        nonlocal run
        for op, value in items:
            chars = _byte(op, value)
            if chars is not None and len(chars) <= _MOST_CHARS:
                folded = {chr(c + 32 if 65 <= c <= 90 else c) for c in chars}
                if len(run) * len(folded) > _MOST_TEXTS:
                    offer(run)
                    run = {""}
                run = {x + c for x in run for c in folded}
                continue
            if op in (_parser.SUBPATTERN, _parser.ATOMIC_GROUP):
                take(value[3] if op is _parser.SUBPATTERN else value)
                continue
            if op is _parser.AT:
                continue
            offer(run)
            run = {""}
            if op is _parser.BRANCH:
                parts = [_factors(x) for x in value[1]]
                offer(None if None in parts or sum(map(len, parts)) > _MOST_TEXTS else set().union(*parts))
            elif op in _REPEATS and value[0] >= 1:
                offer(_factors(value[2]))

    take(items)
    offer(run)
    return best


def bytes_beyond_ascii(regex: str) -> set[int] | None:
    """Bytes from 0x80 of which every hit holds one; None if nothing can be said."""

    def needed(items: Sequence) -> set[int] | None:
        best: set[int] | None = None
        for op, value in items:
            own = _byte(op, value)
            if op is _parser.SUBPATTERN:
                own = needed(value[3])
            elif op is _parser.ATOMIC_GROUP:
                own = needed(value)
            elif op is _parser.BRANCH:
                parts = [needed(x) for x in value[1]]
                own = None if None in parts else set().union(*parts)
            elif op in _REPEATS and value[0] >= 1:
                own = needed(value[2])
            if own and min(own) >= 0x80 and (best is None or len(own) < len(best)):
                best = own
        return best

    return needed(tree_of(regex))
