"""File types by magic signatures.

Signatures are a list known to the driver, by the hundred or thousand. They become constant tables within one expression, whose size does not depend on their
number: a file's leading bytes and the bytes at the offsets that checks read are looked up, and only the signatures found there are tried. They rank so: first
the patterns anchored at the start, longest significant length first; then the checks of the signature registered for the file's extension; then the checks
of all signatures in their order. It is a projection: files are not joined with signatures.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.content import as_latin1, constant, let
from quarrymill.plans.analysis import heads
from quarrymill.plans.patterns import PatternError, byte_regex
from quarrymill.plans.ruletext import Pattern


@dataclass(frozen=True)
class Check:
    compare: str
    offset: int
    from_start: bool
    value: bytes
    mask: bytes = b""


@dataclass(frozen=True)
class Signature:
    id: str
    name: str = ""
    description: str = ""
    pattern: str = ""
    fixed: bool = False
    nocase: bool = False
    encodings: tuple[str, ...] = ("ISO-8859-1",)
    checks: tuple[Check, ...] = ()
    extensions: tuple[str, ...] = ()
    tags: tuple[str, ...] = field(default=())


def parse_offset(text: str) -> tuple[int, bool]:
    """Offset and whether it counts from the start: decimal or 0x hexadecimal, after Z backwards from the end (negative)."""
    m = re.match(r"(Z?)(?:0[xX]([0-9A-Fa-f]*)|(\d*))", text)
    value = int(m[2], 16) if m[2] else int(m[3] or 0)
    return (-value, False) if m[1] else (value, True)


def bytes_of(text: str) -> bytes:
    """Bytes from 0x and hexadecimal digits, or from pairs of decimal digits."""
    digits = text[2:] if text[:2].lower() == "0x" else text
    base = 16 if digits is not text else 10
    return bytes(int(digits[i : i + 2], base) for i in range(0, len(digits) - len(digits) % 2, 2))


_LENGTH = re.compile(r"(?P<byte>\\x..)|(?P<wide>\\.{5})|\{(?P<least>\d+)(?:,(?P<most>\d*))?\}|(?P<set>\[.[^\]]*\])|(?P<dot>\.)|(?P<one>.)", re.S)


def significant_length(pattern: str) -> int:
    """Four times the number of atoms; a count in braces adds to its atom, wild cards do not count."""
    total, before = 0, ""
    for m in _LENGTH.finditer(pattern):
        if m["least"] is not None:
            total += 0 if before == "." else int(m["most"] or m["least"])
            before = "{"
        else:
            total += m.lastgroup != "dot"
            before = m[0][0]
    return 4 * total


def signature_of(doc: dict) -> Signature:
    """A signature from its JSON form."""
    checks = tuple(
        Check(c["compare_type"], *parse_offset(c["offset"]), bytes_of(c["value"]), bytes_of(c.get("pre_process") or "")) for c in doc.get("checks") or ()
    )
    encodings = tuple(e.strip() for e in (doc.get("encoding") or "ISO-8859-1").split(","))
    return Signature(
        doc["id"], doc.get("name") or "", doc.get("description") or "", doc.get("pattern") or "", bool(doc.get("fixed_string")), bool(doc.get("case_insensitive")),
        encodings, checks, tuple(e.upper() for e in doc.get("extensions") or {}), tuple(doc.get("tags") or ()),
    )


# What a check's comparison says of one byte (a, masked) and the expected one (b). `&` is equality and `^` holds unless the bytes are complements.
_FOLDED = lambda x: F.when(x.between(97, 122), x - 32).otherwise(x)
_BYTE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "=/c": lambda a, b: _FOLDED(a) == _FOLDED(b),
    "!": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "&": lambda a, b: a == b,
    "^": lambda a, b: a != 255 - b,
    "OR": lambda a, b: a.bitwiseOR(b) != 0,
    "NOR": lambda a, b: a.bitwiseOR(b) == 0,
}
_CHECK = "struct<compare:string,offset:bigint,from_start:boolean,value:string,mask:string>"


def _row(check: Check) -> dict:
    return {"compare": check.compare, "offset": check.offset, "from_start": check.from_start, "value": check.value.hex(), "mask": check.mask.hex()}


def _place(offset: Column, from_start: Column, size: Column) -> Column:
    return F.when(from_start, offset).otherwise(size + offset)


def _byte_at(digits: Column, i: Column) -> Column:
    """The byte at i (from 0) of hexadecimal digits, as a number."""
    return F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _check(c: Column, content: Column, size: Column) -> Column:
    """Whether a check (a row of _CHECK) holds: false if the file does not reach as far as it reads."""
    n = (F.length(c["value"]) / 2).cast("int")
    at = _place(c["offset"], c["from_start"], size)
    piece = F.lower(F.hex(F.substring(content, (at + 1).cast("int"), n)))

    def byte_holds(i: Column) -> Column:
        mask = F.when(c["mask"] == "", F.lit(255)).otherwise(_byte_at(c["mask"], i % F.greatest(F.lit(1), (F.length(c["mask"]) / 2).cast("int"))))
        return let(F.struct(_byte_at(piece, i).bitwiseAND(mask).alias("a"), _byte_at(c["value"], i).alias("b")), lambda x: compared(x["a"], x["b"]))

    def compared(a: Column, b: Column) -> Column:
        told = F.lit(False)
        for compare, holds in _BYTE.items():
            told = F.when(c["compare"] == compare, holds(a, b)).otherwise(told)
        return told

    whole = (c["compare"] == "=") & (c["mask"] == "")
    each = F.when(n == 0, F.lit(True)).otherwise(F.forall(F.sequence(F.lit(0), n - 1), byte_holds))
    return (at >= 0) & (at + n <= size) & F.when(whole, piece == c["value"]).otherwise(each)


def check_holds(check: Check, content: Column) -> Column:
    """False if the file does not reach as far as the check reads."""
    return _check(F.element_at(constant([_row(check)], f"array<{_CHECK}>"), 1), content, F.octet_length(content))


def signature_faults(signatures: list[Signature]) -> list[PatternError]:
    """Why patterns of signatures cannot be searched. Such a signature is known by its checks alone."""
    faults = []
    for s in signatures:
        try:
            _anchored(s)
        except PatternError as error:
            faults.append(PatternError(f"signature {s.id}: {error}"))
    return faults


def _anchored(s: Signature) -> str | None:
    return byte_regex(Pattern(s.pattern, s.fixed, s.nocase, s.encodings)) if s.pattern else None


def _readable(s: Signature) -> str | None:
    try:
        return _anchored(s)
    except PatternError:
        return None


def _led(regexes: list[str]) -> dict[str, list[int]]:
    """Ordinals of expressions by the two or the one byte that their hits begin with, as hexadecimal digits; under "" those that begin with anything."""
    out: dict[str, list[int]] = {"": []}
    for i, regex in enumerate(regexes):
        for key in heads(regex, 2) or heads(regex, 1) or {b""}:
            out.setdefault(key.hex(), []).append(i)
    return out


def _probed(signatures: list[Signature]) -> tuple[list[dict], dict[str, list[int]]]:
    """Places that tell signatures apart, and the ordinals of signatures by place and bytes there; under "" those without a check for equality."""
    places: dict[str, dict] = {}
    out: dict[str, list[int]] = {"": []}
    for i, s in enumerate(signatures):
        plain = [c for c in s.checks if c.compare == "=" and not c.mask and c.value]
        if not plain:
            out[""].append(i)
            continue
        c = max(plain, key=lambda c: len(c.value))
        n = min(len(c.value), 4)
        name = f"{c.from_start:d} {c.offset} {n} "
        places[name] = {"name": name, "offset": c.offset, "from_start": c.from_start, "n": n}
        out.setdefault(name + c.value[:n].hex(), []).append(i)
    return list(places.values()), out


def identify(files: DataFrame, signatures: list[Signature]) -> DataFrame:
    """files (Name, content) with sig_id, sig_name and sig_stage (1 to 3); null where no signature fits or the content is empty.

    Anchored patterns see the whole content. Of equally long patterns the one that is listed first wins. A pattern that cannot be read is not
    searched; signature_faults() lists it.
    """
    content, size, head = F.col("content"), F.octet_length("content"), F.col("_head")
    by_length = sorted(((s, x) for s in signatures if (x := _readable(s))), key=lambda p: -significant_length(p[0].pattern))
    checked = [s for s in signatures if s.checks]
    first: dict[str, int] = {}
    for i, s in enumerate(signatures):
        for e in s.extensions:
            first.setdefault(e, i)
    ints, none = "map<string,array<int>>", F.array().cast("array<int>")
    ids, names = (constant(x, "array<string>") for x in ([s.id for s in signatures], [s.name or s.description for s in signatures]))
    own = {id(s): i for i, s in enumerate(signatures)}

    def at(table: Column, key: Column) -> Column:
        return F.coalesce(F.try_element_at(table, key), none)

    # Stage 1: patterns by leading bytes; ordinals are ranks.
    regexes = constant([rf"\A(?s:{x})" for _, x in by_length], "array<string>")
    led = constant(_led([x for _, x in by_length]), ints)
    lead = lambda n: F.lower(F.hex(F.substring(content, 1, n)))
    tried = F.concat(*[at(led, k) for k in (lead(2), lead(1), F.lit(""))])
    starts = F.array_min(F.filter(tried, lambda i: F.rlike(head, F.get(regexes, i))))
    anchored = F.get(constant([own[id(s)] for s, _ in by_length], "array<int>"), starts)
    # Stage 2: the signature of the extension. Stage 3: signatures by the bytes at the places that checks read.
    checks = constant([[_row(c) for c in s.checks] for s in signatures], f"array<array<{_CHECK}>>")
    holds = lambda i: F.forall(F.get(checks, i), lambda c: _check(c, content, size))
    extension = F.upper(F.regexp_extract("Name", r"\.([^./]+)$", 1))
    named = F.try_element_at(constant({e: i for e, i in first.items() if signatures[i].checks}, "map<string,int>"), extension)
    places, probed = _probed(checked)
    probed = {k: [own[id(checked[i])] for i in v] for k, v in probed.items()}
    probes = constant(places, "array<struct<name:string,offset:bigint,from_start:boolean,n:int>>")
    seen = lambda p: F.lower(F.hex(F.substring(content, (_place(p["offset"], p["from_start"], size) + 1).cast("int"), p["n"])))
    there = lambda p: _place(p["offset"], p["from_start"], size) >= 0
    table = constant(probed, ints)
    met = F.flatten(F.transform(probes, lambda p: F.when(there(p), at(table, F.concat(p["name"], seen(p)))).otherwise(none)))
    checked_first = F.array_min(F.filter(F.concat(met, at(table, F.lit(""))), holds))

    def told(stage: int, i: Column) -> Column:
        return let(i, lambda i: F.when(i.isNotNull(), F.struct(F.get(ids, i).alias("id"), F.get(names, i).alias("name"), F.lit(stage).alias("stage"))))

    found = F.coalesce(told(1, anchored), told(2, let(named, lambda i: F.when(holds(i), i))), told(3, checked_first))
    seen_whole = files.withColumn("_head", as_latin1(content))
    out = seen_whole.withColumn("_sig", F.when(size > 0, found))
    return out.withColumns({"sig_id": F.col("_sig.id"), "sig_name": F.col("_sig.name"), "sig_stage": F.col("_sig.stage")}).drop("_sig", "_head")
