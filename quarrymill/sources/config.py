"""Small inputs that the driver reads: rule files, keyword lists, signatures, YARA strings."""

from __future__ import annotations

import json
import re
from pathlib import Path

from quarrymill.functions.blake3 import record_id
from quarrymill.operators.signatures import Signature, signature_of
from quarrymill.plans.patterns import PatternError
from quarrymill.plans.ruletext import Call, Pattern, Rule, RuleSet, read_rules


def rule_file(path: str) -> RuleSet:
    if not Path(path).is_file():
        raise FileNotFoundError(f"no rule file {path}")
    return read_rules(Path(path).read_text(errors="replace"))


def rule_folder(path: str) -> RuleSet:
    """Rules of all files directly in a folder. A file's errors do not hide the good rules of any file."""
    if not Path(path).is_dir():
        raise FileNotFoundError(f"no rule folder {path}")
    sets = [rule_file(str(p)) for p in sorted(Path(path).iterdir()) if p.is_file()]
    return RuleSet([r for s in sets for r in s.rules], [e for s in sets for e in s.errors])


def keyword_rule(paths: list[str], name: str = "keywords", encodings: tuple[str, ...] = ("UTF-8", "UTF-16LE")) -> Rule:
    """One rule that any line of the files hits, as literal text in both encodings. Blank lines do not count."""
    lines = list(dict.fromkeys(x for p in paths for x in Path(p).read_text(errors="replace").splitlines() if x))
    patterns = {f"k{i}": Pattern(x, True, False, encodings) for i, x in enumerate(lines, 1)}
    return Rule(name, patterns=patterns, condition=Call("any", ()), id=record_id(name, *lines))


def signatures_from_json(text: str) -> list[Signature]:
    return [signature_of(d) for d in json.loads(text)]


def signature_file(path: str) -> list[Signature]:
    if not Path(path).is_file():
        raise FileNotFoundError(f"no signature file {path}")
    return signatures_from_json(Path(path).read_text())


def yara_pattern(text: str, modifiers: tuple[str, ...] = ()) -> Pattern:
    """A YARA string as a pattern: hexadecimal bytes in braces, with wild cards, jumps and alternatives, or text with wide, ascii, nocase and fullword.
    Raises PatternError for braces that hold anything else."""
    if m := re.fullmatch(r"\{(.*)\}", text.strip(), re.S):
        return Pattern(_hex_pattern(m[1]))
    quoted = re.sub(r"([^\w\s])", r"\\\1", text)
    wide = [] if "wide" not in modifiers else ["UTF-16LE"]
    plain = [] if wide and "ascii" not in modifiers else ["ASCII"]
    return Pattern(rf"\W{quoted}\W" if "fullword" in modifiers else quoted, False, "nocase" in modifiers, tuple(plain + wide))


_HEX = re.compile(r"(?P<space>\s+)|(?P<byte>[0-9A-Fa-f?]{2})|\[\s*(?P<least>\d*)\s*(?P<dash>-?)\s*(?P<most>\d*)\s*\]|(?P<sign>[(|)])|(?P<bad>.)", re.S)


def _hex_pattern(text: str) -> str:
    out, depth = [], 0
    for m in _HEX.finditer(text):
        if m["byte"]:
            high, low = m["byte"]
            if high != "?":
                out.append(rf"\z{high}{low}" if low != "?" else rf"[\z{high}0-\z{high}f]")
            else:
                out.append(r"[\z00-\zff]" if low == "?" else "[" + "".join(rf"\z{x:x}{low}" for x in range(16)) + "]")
        elif m["sign"]:
            depth += {"(": 1, ")": -1, "|": 0}[m["sign"]]
            out.append(m["sign"])
        elif m["dash"] or m["least"]:
            least = m["least"] or "0"
            out.append(r"[\z00-\zff]" + (f"{{{least},{m['most']}}}?" if m["dash"] else f"{{{least}}}"))
        if m["bad"] or m[0].startswith("[") and not (m["dash"] or m["least"]) or depth < 0:
            raise PatternError(f"cannot read hexadecimal string {{{text}}}")
    if depth or not out:
        raise PatternError(f"cannot read hexadecimal string {{{text}}}")
    return "".join(out)
