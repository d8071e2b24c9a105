"""Rules as columns: every rule becomes one predicate, so that one pass over the files answers all of them.

A file's hits of a pattern are an array of (gap, size): bytes between the end of the hit before and its start, and its length.
Counts, lengths and offsets follow from it within the row; nothing is shuffled. A pattern is searched only in files that pass the metadata and hash sections of a
rule that uses it and that hold a text which its hits need, and no further than conditions ask: whether it has hits, how many, or where.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.content import as_latin1, constant, digest, let
from quarrymill.plans.analysis import bytes_beyond_ascii
from quarrymill.plans.patterns import byte_regex, needed_texts
from quarrymill.plans.prefilter import MANY, candidates
from quarrymill.plans.ruletext import ALGORITHMS, Both, Call, Either, Pattern, Property, Rule, calls_in, terms_of

PROPERTY_COLUMNS = {"created": "Created", "modified": "Modified", "filesize": "Filesize", "filepath": "Path", "filename": "Name"}
SIGNATURE_COLUMNS = {"name": "sig_name", "id": "sig_id"}
_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


#: How often `and` and `or` may alternate on the way down a condition: expressions of Spark are no deeper than that.
DEEPEST = 100


def balanced(join: Callable[[Column, Column], Column], items: list[Column]) -> Column:
    """Columns joined pairwise, so that the expression is as deep as the logarithm of their number."""
    while len(items) > 1:
        items = [join(*items[i : i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def _fold(node: object, leaf: Callable[[object], Column], one_of: Callable[[str, list], Column] | None = None) -> Column:
    """A condition as a column. one_of says that a property equals one of many values."""
    if isinstance(node, Both):
        return balanced(and_, [_fold(x, leaf, one_of) for x in terms_of(node, Both)])
    if isinstance(node, Either):
        equal: dict[str, list] = {}
        parts = []
        for x in terms_of(node, Either):
            if one_of and isinstance(x, Property) and x.op == "==":
                equal.setdefault(x.name, []).append(x.value)
            else:
                parts.append(_fold(x, leaf, one_of))
        return balanced(or_, parts + [one_of(name, values) for name, values in equal.items()])
    return leaf(node)


def _properties(node: object, columns: dict[str, str]) -> Column:
    return _fold(node, lambda p: _property(p, columns), lambda name, values: F.col(columns[name]).isin(values))


def _property(node: Property, columns: dict[str, str]) -> Column:
    return _COMPARE[node.op](F.col(columns[node.name]), F.lit(node.value))


def metadata_predicate(rule: Rule) -> Column:
    return F.lit(True) if rule.metadata is None else _properties(rule.metadata, PROPERTY_COLUMNS)


def hash_predicate(rule: Rule) -> Column:
    """All digests of a record, of any record. Digests are compared in lower case."""
    single: dict[str, list[str]] = {}
    records = []
    for r in rule.hashes:
        if len(r) == 1:
            ((a, v),) = r.items()
            single.setdefault(a, []).append(v.lower())
        else:
            records.append(reduce(and_, [F.col(f"_{a}") == F.lit(v.lower()) for a, v in r.items()]))
    records += [F.col(f"_{a}").isin(values) for a, values in single.items()]
    return balanced(or_, records) if records else F.lit(True)


def signature_predicate(rule: Rule) -> Column:
    if rule.signature is None:
        return F.lit(True)
    return F.coalesce(_properties(rule.signature, SIGNATURE_COLUMNS), F.lit(False))


#: Marks before and behind each hit; a view of bytes has neither character.
_FROM, _TO = "\ue000", "\ue001"


def gaps_and_sizes(view: Column, regex: str | Column) -> Column:
    """Hits in order. One pass of the expression puts marks around them; cutting at the marks tells the sizes."""
    whole = F.lit(f"(?s){regex}") if isinstance(regex, str) else F.concat(F.lit("(?s)"), regex)
    pieces = F.split(F.regexp_replace(view, whole, F.lit(f"{_FROM}$0{_TO}")), _FROM)

    def sizes(x: Column) -> Column:
        before = lambda i: F.get(x, i)
        return F.transform(
            F.slice(x, F.lit(2), F.size(x) - 1), lambda hit, i: F.struct((F.length(before(i)) - F.instr(before(i), _TO)).alias("gap"), (F.instr(hit, _TO) - 1).alias("size"))
        )

    return let(pieces, sizes)


def hit_ends(hits: Column) -> Column:
    """Where each hit ends, as an array of longs. Each pass adds to every sum the one that ends where it begins, so sums of 1, 2, 4 and so on hits come of the
    sizes, and as many passes as the number of hits has binary digits give all."""
    sizes = F.transform(hits, lambda h: h["gap"].cast("long") + h["size"])
    steps = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(hits))) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))
    passed = F.aggregate(steps, sizes, lambda sums, n: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - n), F.lit(0).cast("long"))))
    return F.when(F.size(hits) > 1, passed).otherwise(sizes)


def may_hit(pattern: Pattern, view: Column, lower: Column) -> Column | None:
    """Whether a file holds a text that the pattern's hits need, or else a byte beyond ASCII that they need."""
    texts = needed_texts(pattern)
    hay = lower if pattern.nocase else view
    if texts:
        return reduce(or_, [F.contains(hay, F.lit(t.decode("latin-1"))) for t in texts])
    needed = bytes_beyond_ascii(byte_regex(pattern))
    return F.rlike(view, F.lit("[" + "".join(rf"\x{b:02x}" for b in sorted(needed)) + "]")) if needed else None


#: What conditions ask of a pattern: whether, how many, or where.
_SOME, _COUNT, _PLACES = range(3)
_ASKS = {"any": _SOME, "all": _SOME, "count_has_hits": _SOME, "count": _COUNT, "length": _PLACES, "offset": _PLACES}


def _asked(rule: Rule) -> dict[str, int]:
    """The most that the condition of a rule asks of each of its patterns."""
    out: dict[str, int] = {}
    for call in calls_in(rule.condition):
        for k in (a for a in call.args or rule.patterns if a in rule.patterns):
            out[k] = max(out.get(k, _SOME), _ASKS[call.name])
    return out


def _call(node: Call, hits: dict[str, tuple[Column, Column | None]]) -> Column:
    """hits: for each pattern the number of hits (1 for some, if no more is asked) and, if asked for, their array."""
    compare = _COMPARE.get(node.op)
    asked = [hits.get(a) for a in node.args if not a.isdigit()] if node.args else list(hits.values())
    counts = [F.lit(0) if h is None else F.coalesce(h[0], F.lit(0)) for h in asked]
    if node.name == "any":
        return balanced(or_, [c > 0 for c in counts]) if counts else F.lit(False)
    if node.name == "all":
        return balanced(and_, [c > 0 for c in counts]) if counts else F.lit(True)
    if node.name == "count":
        return compare(counts[0], node.value)
    if node.name == "count_has_hits":
        return compare(balanced(add, [F.lit(0), *[(c > 0).cast("int") for c in counts]]), node.value)
    hit, nth = asked[0] and asked[0][1], int(node.args[1]) if len(node.args) > 1 else None
    if hit is None:
        return F.lit(False)
    if node.name == "length":
        found = F.exists(hit, lambda h: compare(h["size"], node.value)) if nth is None else compare(F.get(hit, nth - 1)["size"], node.value)
    elif nth is None:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("found"))
        step = lambda a, h: F.struct((a["at"] + h["gap"] + h["size"]).alias("at"), (a["found"] | compare(a["at"] + h["gap"], node.value)).alias("found"))
        found = F.aggregate(hit, zero, step, lambda a: a["found"])
    else:
        before = F.aggregate(F.slice(hit, 1, max(nth, 1)), F.lit(0).cast("long"), lambda a, h: a + h["gap"] + h["size"])
        found = (F.size(hit) >= nth) & F.lit(nth > 0) & compare(before - F.get(hit, nth - 1)["size"], node.value)
    return F.coalesce(found, F.lit(False))


def patterns_of(rules: list[Rule], asked_only: bool = False) -> dict[str, list[tuple[Rule, str, Pattern]]]:
    """Expressions of the rules' patterns, each with the patterns that it stands for."""
    out: dict[str, list[tuple[Rule, str, Pattern]]] = {}
    for r in rules:
        asked = _asked(r)
        for k, p in r.patterns.items():
            if not asked_only or k in asked:
                out.setdefault(byte_regex(p), []).append((r, k, p))
    return out


_HITS = "array<struct<gap:int,size:int>>"


def found_by_automaton(view: Column, content: Column, regexes: list[str]) -> tuple[Column, Callable[[Column], Column]]:
    """Candidates of each file, and, from a column with them, the hits of those that have any: an array of struct(i, hits) with i the ordinal of the expression."""
    spelled = constant(regexes, "array<string>")

    def search(wanted: Column) -> Column:
        each = F.transform(wanted, lambda i: F.struct(i.alias("i"), gaps_and_sizes(view, F.get(spelled, i)).alias("hits")))
        return F.filter(each, lambda x: F.size(x["hits"]) > 0)

    return candidates(content, regexes), search


def _counts_patterns(rule: Rule) -> tuple[list[str], str, int] | None:
    """Of a rule that only asks how many of its patterns have hits, and never holds without one: the patterns, the comparison and the number."""
    call = rule.condition
    if not isinstance(call, Call) or rule.metadata is not None or rule.signature is not None or rule.hashes or call.name not in ("any", "all", "count_has_hits"):
        return None
    asked = list(call.args or rule.patterns)
    op, value = {"any": (">=", 1), "all": (">=", len(asked))}.get(call.name) or (call.op, call.value)
    holds_without = {"==": value == 0, "!=": value != 0, ">": value < 0, ">=": value <= 0, "<": value > 0, "<=": value >= 0}[op]
    return None if holds_without else (asked, op, value)


def _ids_by_counts(found: Column, rules: list[Rule], at: dict[str, int]) -> Column:
    """Ids of rules that _counts_patterns() knows and that hold, from the hits of each file (struct(i, hits)): looked up by the expressions that hit."""
    of: list[list[int]] = [[] for _ in at]
    ops, values = [], []
    for n, r in enumerate(rules):
        asked, op, value = _counts_patterns(r)
        ops.append(op)
        values.append(value)
        for k in asked:
            if k in r.patterns:
                of[at[byte_regex(r.patterns[k])]].append(n)
    tables = [constant(x, t) for x, t in ((of, "array<array<int>>"), (ops, "array<string>"), (values, "array<int>"), ([r.id for r in rules], "array<string>"))]
    met = F.flatten(F.transform(found, lambda x: F.get(tables[0], x["i"])))

    def holds(every: Column, n: Column) -> Column:
        count, op, value = F.size(F.filter(every, lambda m: m == n)), F.get(tables[1], n), F.get(tables[2], n)
        return balanced(or_, [(op == name) & compare(count, value) for name, compare in _COMPARE.items()])

    return let(met, lambda every: F.transform(F.filter(F.array_distinct(every), lambda n: holds(every, n)), lambda n: F.get(tables[3], n)))


def with_answers(files: DataFrame, rules: list[Rule], metadata_only: bool = False, everywhere: bool = False, digests: tuple[str, ...] = ()) -> DataFrame:
    """files with _ids, the ids of the rules that hold, and with everywhere also _hits, the hits of all patterns in all files: an array of
    struct(i, hits), i being the ordinal in patterns_of(rules). digests are computed for all files, as _md5 and so on.

    From prefilter.MANY expressions on, one automaton tells which of them may hit a file, and only these are tried; rules that count patterns with hits are then
    looked up by what hit. Otherwise each pattern has a column of its own.
    """
    asked = patterns_of(rules, not everywhere)
    if metadata_only or len(asked) < MANY:
        searched, predicates, columns = _with_predicates(files, rules, metadata_only, everywhere, digests)
        ids = F.array_compact(F.array(*[F.when(p, F.lit(r.id)) for r, p in zip(rules, predicates)])) if rules else F.array().cast("array<string>")
        told = searched.withColumn("_ids", ids)
        if not everywhere:
            return told
        hits = [F.struct(F.lit(i).alias("i"), F.col(columns[x]).alias("hits")) for i, x in enumerate(asked)]
        return told.withColumn("_hits", F.filter(F.array(*hits), lambda x: F.size(x["hits"]) > 0) if hits else F.array().cast(f"array<struct<i:int,hits:{_HITS}>>"))
    at = {x: i for i, x in enumerate(asked)}
    content = F.col("content")
    if not everywhere and all(not _free(r) for r in rules):
        # No file is searched that passes no rule's other sections.
        hashed = _hashed(files, rules, digests)
        content = F.when(balanced(or_, [_gate(r) for r in rules]), content)
    else:
        hashed = _hashed(files, rules, digests)
    may, search = found_by_automaton(F.col("_view"), F.col("_sought"), list(asked))
    viewed = hashed.withColumn("_sought", content).withColumn("_may", may).withColumn("_view", as_latin1(F.col("_sought")))
    searched = viewed.withColumn("_hits", search(F.col("_may"))).drop("_may", "_view", "_sought")
    counting = [r for r in rules if _counts_patterns(r)]
    others = [r for r in rules if not _counts_patterns(r)]
    ids = [_ids_by_counts(F.col("_hits"), counting, at)] if counting else []
    if others:
        searched = searched.withColumn("_of", F.map_from_entries("_hits"))
        tests = []
        for r in others:
            hits = {}
            for k in _asked(r):
                own = F.try_element_at("_of", F.lit(at[byte_regex(r.patterns[k])]))
                hits[k] = (F.coalesce(F.size(own), F.lit(0)), own)
            tests.append(F.when(_gate(r) if r.condition is None else _gate(r) & _fold(r.condition, lambda c, own=hits: _call(c, own)), F.lit(r.id)))
        ids.append(F.array_compact(F.array(*tests)))
    return searched.withColumn("_ids", F.concat(*ids) if ids else F.array().cast("array<string>"))


def _free(rule: Rule) -> bool:
    """Whether a rule has no section but its patterns."""
    return rule.metadata is None and rule.signature is None and not rule.hashes


def _gate(rule: Rule) -> Column:
    return F.coalesce(metadata_predicate(rule) & hash_predicate(rule) & signature_predicate(rule), F.lit(False))


def _hashed(files: DataFrame, rules: list[Rule], digests: tuple[str, ...]) -> DataFrame:
    used = {a for r in rules for record in r.hashes for a in record}
    own = {f"_{a}": digest(a, F.col("content")) for a in digests}
    own |= {f"_{a}": _digest_where(a, [r for r in rules if any(a in record for record in r.hashes)]) for a in ALGORITHMS if a in used and a not in digests}
    return files.withColumns(own) if own else files


def _with_predicates(files: DataFrame, rules: list[Rule], metadata_only: bool, everywhere: bool, digests: tuple[str, ...]) -> tuple[DataFrame, list[Column], dict[str, str]]:
    """files with the columns that the rules need, a predicate per rule over them, and the column of hits of each expression."""
    if metadata_only and not everywhere:
        return files, [F.coalesce(metadata_predicate(r), F.lit(False)) for r in rules], {}
    hashed = _hashed(files, rules, digests)
    gates = [_gate(r) for r in rules]
    searches: dict[str, tuple[list[Column], int, Pattern]] = {}
    for rule, gate in zip(rules, gates):
        asked = dict.fromkeys(rule.patterns, _PLACES) if everywhere else _asked(rule)
        for k, most in asked.items():
            p = rule.patterns[k]
            before, level, _ = searches.get(regex := byte_regex(p), ([], _SOME, p))
            searches[regex] = ([*before, gate], max(level, most), p)
    view, lower = F.col("_view"), F.col("_lower")
    viewed = hashed.withColumn("_view", as_latin1(F.col("content"))) if searches else hashed
    if any(p.nocase for _, _, p in searches.values()):
        viewed = viewed.withColumn("_lower", F.lower("_view"))
    found: dict[str, Column] = {}
    for regex, (of, level, p) in searches.items():
        sought = [lambda x: F.rlike(view, F.lit(f"(?s){x}")).cast("int"), lambda x: F.regexp_count(view, F.lit(f"(?s){x}")), lambda x: gaps_and_sizes(view, x)][level](regex)
        needed, wanted = may_hit(p, view, lower), None if everywhere else balanced(or_, of)
        conditions = [c for c in (wanted, needed) if c is not None]
        found[regex] = F.when(reduce(and_, conditions), sought) if conditions else sought
    name = {regex: f"_hits_{i}" for i, regex in enumerate(found)}
    searched = viewed.withColumns({name[x]: c for x, c in found.items()}) if found else viewed
    if metadata_only:
        return searched, [F.coalesce(metadata_predicate(r), F.lit(False)) for r in rules], name
    predicates = []
    for rule, gate in zip(rules, gates):
        hits = {}
        for k in _asked(rule):
            column, places = F.col(name[byte_regex(rule.patterns[k])]), searches[byte_regex(rule.patterns[k])][1] == _PLACES
            hits[k] = (F.when(column.isNotNull(), F.size(column)) if places else column, column if places else None)
        predicates.append(gate if rule.condition is None else gate & _fold(rule.condition, lambda c, own=hits: _call(c, own)))
    return searched, predicates, name


def _digest_where(algorithm: str, rules: list[Rule]) -> Column:
    """The digest of files that pass the metadata section of a rule that asks for it. Python sees no others."""
    wanted = balanced(or_, [F.coalesce(metadata_predicate(r), F.lit(False)) for r in rules])
    return digest(algorithm, F.when(wanted, F.col("content")))
