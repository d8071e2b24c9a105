"""Rules as text and as values.

A rule has a name and up to five sections, in this order: meta, hash, file_metadata, signature, grep. Reading keeps the good rules of a text and reports
the bad ones with line and column (in bytes).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from quarrymill.functions.blake3 import field_bytes, blake3_hex

# Words of the language, the comparisons and types that properties take, and arguments of functions.
KEYWORDS = {
    "rule", "meta", "file_metadata", "signature", "grep", "patterns", "hash", "condition", "md5", "sha1", "sha256", "blake3",
    "encodings", "nocase", "fixed", "and", "or",
}
ALGORITHMS = ("md5", "sha1", "sha256", "blake3")
COMPARISONS = ("==", "!=", ">", ">=", "<", "<=")
PROPERTIES = {
    "file_metadata": {
        "created": (COMPARISONS, "string"), "modified": (COMPARISONS, "string"), "filesize": (COMPARISONS, "number"),
        "filepath": (("==", "!="), "string"), "filename": (("==", "!="), "string"),
    },
    "signature": {"name": (("==",), "string"), "id": (("==",), "string")},
}
#: Fewest and most arguments, and whether a comparison follows.
FUNCTIONS = {
    "all": (0, None, False), "any": (0, None, False), "offset": (1, 2, True), "count": (1, 1, True), "count_has_hits": (0, None, True), "length": (1, 2, True),
}
NAMES = {
    "{": "open brace", "}": "close brace", "(": "open parenthesis", ")": "close parenthesis", ":": "colon", "=": "equal sign", "==": "equality operator",
    "identifier": "identifier", "string": "double quoted string", "number": "number",
}


class RuleError(ValueError):
    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{message} at line {line} column {column}")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    column: int


@dataclass(frozen=True)
class Property:
    name: str
    op: str
    value: str | int


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[str, ...]
    op: str | None = None
    value: int | None = None


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Pattern:
    text: str
    fixed: bool = False
    nocase: bool = False
    encodings: tuple[str, ...] = ()


@dataclass
class Rule:
    name: str
    meta: dict[str, str] = field(default_factory=dict)
    hashes: list[dict[str, str]] = field(default_factory=list)
    metadata: object = None
    signature: object = None
    patterns: dict[str, Pattern] = field(default_factory=dict)
    condition: object = None
    #: Identity of the rule's body: equal bodies have equal ids, whatever their names and meta sections.
    id: str = blake3_hex(b"")


@dataclass
class RuleSet:
    rules: list[Rule]
    errors: list[RuleError]


_TOKEN = re.compile(
    r"""(?P<space>[\t\r\ ]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<open_comment>/\*)|"(?P<string>(?:[^"\\]|\\.)*)"|(?P<open_string>")
    |(?P<number>[0-9]+)|(?P<identifier>[A-Za-z][A-Za-z0-9_-]*)|(?P<sign>[=!<>]=|[(){},:=<>])|(?P<bad>[!/])|(?P<other>.)""",
    re.X | re.S,
)


def tokens_of(text: str) -> tuple[list[Token], list[RuleError]]:
    """Tokens, the last being `end`, and errors of the text itself. One character stands for one byte of the text."""
    raw, tokens, errors, line, column, at = text.encode().decode("latin-1"), [], [], 1, 1, 0
    while at < len(raw):
        m = _TOKEN.match(raw, at)
        kind, found = m.lastgroup, m[m.lastgroup]
        here, size = (line, column), len(m[0])
        if kind == "open_string" or kind == "open_comment":
            errors.append(RuleError("Unterminated string" if kind == "open_string" else "Unterminated multi-line comment", *here))
            size = len(raw) - at
        elif kind == "bad":
            errors.append(RuleError("Unexpected input character: " + {"!": "!", "/": "/ at "}[found], *here))
        elif kind == "identifier":
            tokens.append(Token(found if found in KEYWORDS else kind, found, *here))
        elif kind in ("string", "number", "sign", "other"):
            tokens.append(Token(found if kind == "sign" else kind, found.encode("latin-1").decode(errors="replace"), *here))
        seen = raw[at : at + size]
        if kind in ("line", "comment", "open_comment") and "\n" in seen:
            line, column = line + seen.count("\n"), len(seen) - seen.rindex("\n")
        else:
            column += size
        at += size
    return [*tokens, Token("end", "", line, column)], errors


class _Reader:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str, token: Token | None = None) -> RuleError:
        token = token or self.now
        return RuleError(message, token.line, token.column)

    def take(self, *kinds: str) -> Token | None:
        if self.now.kind in kinds:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, *kinds: str, says: str = "") -> Token:
        found = self.take(*kinds)
        if found is None:
            raise self.fail(f"Expected {says or NAMES.get(kinds[0], kinds[0] + ' keyword')}")
        return found

    def rule(self) -> Rule:
        self.need("rule")
        rule = Rule(self.need("identifier").text)
        self.need("{")
        if self.take("meta"):
            self.need(":")
            while key := self.take("identifier"):
                self.need("=")
                rule.meta.setdefault(key.text, self.need("string").text)
        begin = self.at
        for section, read in (("hash", self._hashes), ("file_metadata", self._properties), ("signature", self._properties), ("grep", self._grep)):
            if self.take(section):
                self.need(":")
                read(rule, section)
        rule.id = blake3_hex(field_bytes(*[t.text for t in self.tokens[begin : self.at]]))
        self.need("}")
        return rule

    def _hashes(self, rule: Rule, section: str) -> None:
        while self.now.kind in ALGORITHMS:
            record: dict[str, str] = {}
            while True:
                algorithm = self.need(*ALGORITHMS, says="hash type")
                if algorithm.kind in record:
                    raise self.fail("Duplicate hash type", algorithm)
                self.need("==")
                record[algorithm.kind] = self.need("string").text
                if not self.take(","):
                    break
            rule.hashes.append(record)
        if not rule.hashes:
            raise self.fail("No hash algorithms specified")

    def _properties(self, rule: Rule, section: str) -> None:
        setattr(rule, {"file_metadata": "metadata"}.get(section, section), self._either(lambda: self._property(section)))

    def _either(self, factor: Callable[[], object]) -> object:
        """Factors joined by `and` and `or`, with brackets to any depth: one list of terms for each open bracket."""
        open_: list[tuple[list, list]] = [([], [])]
        while True:
            if self.take("("):
                open_.append(([], []))
                continue
            found = factor()
            while True:
                eithers, boths = open_[-1]
                boths.append(found)
                if self.take("and"):
                    break
                eithers.append(reduce(Both, boths))
                boths.clear()
                if self.take("or"):
                    break
                found = reduce(Either, eithers)
                open_.pop()
                if not open_:
                    return found
                self.need(")")

    def _property(self, section: str) -> Property:
        name = self.now
        if name.text not in PROPERTIES[section]:
            raise self.fail("Unexpected property name in section")
        ops, kind = PROPERTIES[section][name.text]
        self.at += 1
        if not (op := self.take(*ops)):
            raise self.fail("Unsupported operator for property")
        if not (value := self.take(kind)):
            raise self.fail("Unsupported type for right operand")
        return Property(name.text, op.kind, int(value.text) if kind == "number" else value.text)

    def _grep(self, rule: Rule, section: str) -> None:
        self.need("patterns")
        self.need(":")
        while key := self.take("identifier"):
            self.need("=")
            rule.patterns.setdefault(key.text, self._pattern())
        if not rule.patterns:
            raise self.fail("No patterns specified")
        self.need("condition")
        self.need(":")
        rule.condition = self._either(self._call)

    def _pattern(self) -> Pattern:
        if self.take("{"):
            return self._hex()
        if not (text := self.take("string")):
            raise self.fail("Expected double quoted string or hex string")
        fixed, nocase, encodings = bool(self.take("fixed")), bool(self.take("nocase")), []
        if self.take("encodings"):
            self.need("=")
            encodings.append(self.need("identifier").text)
            while self.take(","):
                encodings.append(self.need("identifier").text)
        return Pattern(text.text, fixed, nocase, tuple(encodings))

    def _hex(self) -> Pattern:
        digits = ""
        while self.now.kind not in ("}", "end"):
            part = self.now
            if part.kind not in ("identifier", "number"):
                raise self.fail("Expected hex digit")
            self.at += 1
            if not re.fullmatch("[0-9A-Fa-f]+", part.text):
                raise self.fail("Invalid hex digit", part)
            digits += part.text
        if self.now.kind == "end":
            raise self.fail("Unterminated hex string")
        if len(digits) % 2:
            raise self.fail("Odd number of hex digits")
        if not digits:
            raise self.fail("Empty hex string")
        self.need("}")
        return Pattern("".join(rf"\z{digits[i : i + 2]}" for i in range(0, len(digits), 2)))

    def _call(self) -> Call:
        name = self.now.text
        if name not in FUNCTIONS:
            raise self.fail("Expected function call or signature definition")
        self.at += 1
        after, args, op, value = self.now, [], None, None
        self.need("(")
        if first := self.take("identifier"):
            args.append(first.text)
            while self.take(","):
                args.append(self.need("identifier", "number", says="identifier or number").text)
        self.need(")")
        if sign := self.take("=", *COMPARISONS):
            op, value = "==" if sign.kind == "=" else sign.kind, int(self.need("number").text)
        least, most, compares = FUNCTIONS[name]
        if compares and op is None:
            raise self.fail("Expected operator and value for comparison", after)
        if not compares and op is not None:
            raise self.fail("Unexpected operator or value for function", after)
        if len(args) < least or most is not None and len(args) > most:
            raise self.fail("Invalid number of arguments", after)
        return Call(name, tuple(args), op, value)


def read_rules(text: str) -> RuleSet:
    """The good rules of a text, and its errors: a bad rule is left out, and reading goes on at the next `rule`."""
    tokens, errors = tokens_of(text)
    reader, rules = _Reader(tokens), []
    for start in [i for i, t in enumerate(tokens) if t.kind == "rule"]:
        if reader.now.kind == "end":
            break
        if reader.now.kind != "rule":
            errors.append(reader.fail(f"Unexpected token {reader.now.text}"))
        reader.at = start
        try:
            rules.append(reader.rule())
        except RuleError as error:
            errors.append(error)
    if reader.now.kind != "end":
        errors.append(reader.fail(f"Unexpected token {reader.now.text}"))
    return RuleSet(rules, errors)


def terms_of(node: object, kind: type) -> list:
    """The terms of a chain of Both or of Either, in order; the node itself if it is none."""
    out, left = [], [node]
    while left:
        x = left.pop()
        if isinstance(x, kind):
            left += [x.right, x.left]
        else:
            out.append(x)
    return out


def depth_of(node: object) -> int:
    """How often `and` and `or` alternate on the way down."""
    deepest, left = 0, [(node, 0)]
    while left:
        x, depth = left.pop()
        deepest = max(deepest, depth)
        if isinstance(x, (Both, Either)):
            left += [(y, depth + 1) for y in terms_of(x, type(x))]
    return deepest


def calls_in(node: object) -> Iterator[Call]:
    left = [node]
    while left:
        x = left.pop()
        if isinstance(x, Call):
            yield x
        elif isinstance(x, (Both, Either)):
            left += [x.right, x.left]
