"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is parsed against it greedily:
each phrase is the longest match that starts where the last one ended. Phrases times the bits to point into the
sample, per character, estimate the cross entropy; the language with the least wins. The automata are made into one table of
(state, character class) -> state whose lowest bit marks the start of a phrase, so a batch of texts is parsed by all
languages at once, one gather per character position. Only the most frequent characters have a column there; moves by all other characters of the
samples are searched in a sorted list, so every character counts and memory is bounded by the samples. Long texts are parsed in several lanes, with the phrases of one parse.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, columns, quoted, read_table, unused

#: Characters of a lane, and how many before its own it starts with.
LANE, LEAD = 2048, 256
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Parser:
    languages: list[str]
    classes: np.ndarray  # of each code point, from 1 on, the most frequent first; 0 if no sample has it
    k: int  # classes below k have a column in the table
    table: np.ndarray  # [state * k + class] -> next state * k, shifted left by one, plus 1 at the start of a phrase
    roots: np.ndarray  # states to start from
    bits: np.ndarray  # to point into each sample
    moves: np.ndarray  # sorted (state << 21 | class) of all moves by other classes
    to: np.ndarray  # where each leads, as in the table
    tops: np.ndarray  # state of each language whose moves begin a phrase


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of codes; state 0 is the root."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


def _plain(text: str) -> str:
    """The words of letters, in lower case, with one space between: digits and signs say nothing of a language."""
    return " ".join(LETTERS.findall(text.lower()))


def build_parser(samples: dict[str, str], most_classes: int = 64) -> Parser:
    """samples: text by language. The most_classes - 1 most frequent characters of all samples are looked up in a table, the others in a sorted list."""
    plain = {k: _plain(v) for k, v in sorted(samples.items()) if _plain(v)}
    seen = Counter()
    for v in plain.values():
        seen.update(v)
    letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
    classes = np.zeros(0x110000, np.int32)
    classes[[ord(c) for c in letters]] = range(1, len(letters) + 1)
    k, tables, roots, base, tops, sparse = min(len(letters) + 1, most_classes), [], [], 0, [], {}
    for v in plain.values():
        go = suffix_automaton(classes[_points(v)].tolist())
        # Where a phrase begins: behind its first character, or, if the sample lacks that, in a last state that every character leaves for a new phrase.
        fresh = np.full(k, len(go), np.int64)
        for c, to in go[0].items():
            if c < k:
                fresh[c] = to
        table = np.tile(((fresh + base) * k << 1) + 1, (len(go) + 1, 1))
        for s, moves in enumerate(go):
            near = {c: to for c, to in moves.items() if c < k}
            table[s, list(near)] = [(to + base) * k << 1 for to in near.values()]
            # No lane is ever in state 0: its moves are those that begin a phrase.
            sparse.update({(s + base) << 21 | c: ((to + base) * k << 1) + (s == 0) for c, to in moves.items() if c >= k})
        if table.max(initial=0) >= 1 << 31:
            raise ValueError("samples are too long for this many languages")
        tables.append(table.astype(np.int32).ravel())
        roots.append((base + len(go)) * k)
        tops.append(base)
        base += len(go) + 1
    moves = np.array(sorted(sparse), np.int64)
    to = np.array([sparse[m] for m in moves.tolist()], np.int32)
    bits = np.log2([max(2, len(v)) for v in plain.values()])
    whole = np.concatenate(tables) if tables else np.zeros(0, np.int32)
    return Parser(list(plain), classes, k, whole, np.array(roots, np.int32), bits, moves, to, np.array(tops, np.int64))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def phrases(parser: Parser, texts: list[str]) -> np.ndarray:
    """Phrases of each text (rows) for each language (columns), as if each text were parsed from its first character to its last.

    Long texts are parsed in lanes of LANE characters at once. A lane starts LEAD characters early, since parses of one text that start at different places soon
    meet in one state. Where the state that it enters its own part with isn't the one the lane before it ended in, that part is parsed again from there.
    """
    codes = [parser.classes[p] for p in map(_points, texts)]
    size = np.fromiter(map(len, codes), np.int64, len(codes))
    whole = np.concatenate(codes) if len(codes) else np.zeros(0, np.int32)
    rare = whole >= parser.k
    coded = np.where(rare, 0, whole), whole, rare if rare.any() else None
    pieces = -(-size // LANE)
    owner = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(size) - size, pieces) + nth * LANE
    length = np.minimum(size[owner] - nth * LANE, LANE)
    begun, entered, ended = _walk(parser, coded, start, length, np.where(nth > 0, LEAD, 0), np.repeat(parser.roots[:, None], len(owner), axis=1))
    while True:
        wrong = np.zeros(len(owner), bool)
        wrong[1:] = (nth[1:] > 0) & (entered[:, 1:] != ended[:, :-1]).any(0)
        again = np.flatnonzero(wrong & ~np.append(False, wrong[:-1]))
        if not len(again):
            break
        entered[:, again] = ended[:, again - 1]
        begun[:, again], _, ended[:, again] = _walk(parser, coded, start[again], length[again], np.zeros(len(again), np.int64), entered[:, again])
    return np.array([np.bincount(owner, weights=row, minlength=len(texts)) for row in begun], np.int64).reshape(len(parser.languages), len(texts)).T


def _walk(
    parser: Parser, coded: tuple[np.ndarray, np.ndarray, np.ndarray | None], start: np.ndarray, length: np.ndarray, lead: np.ndarray, state: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parse the characters from start to start + length in each lane from the given states (languages by lanes), lead (0 or LEAD) characters before them first.
    coded: the column, the class and, if there are any, the lack of a column of each character. Phrases that begin behind the lead, the states there and the last states."""
    column, whole, rare = coded
    order = np.argsort(-(length + lead), kind="stable")
    first, steps, led = (start - lead)[order], (length + lead)[order], lead[order] > 0
    state = state[:, order].copy()
    entered, begun, left = state.copy(), np.zeros(state.shape, np.int32), len(order)
    for t in range(int(steps.max(initial=0))):
        while left and steps[left - 1] <= t:
            left -= 1
        if t == LEAD:
            entered[:, led], begun[:, led] = state[:, led], 0
        at = first[:left] + t
        step = parser.table[state[:, :left] + column[at]]
        if rare is not None and len(lanes := np.flatnonzero(rare[at])):
            step[:, lanes] = _rare_steps(parser, state[:, lanes], whole[at[lanes]])
        begun[:, :left] += step & 1
        state[:, :left] = step >> 1
    back = np.argsort(order)
    return begun[:, back], entered[:, back], state[:, back]


def _rare_steps(parser: Parser, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """What the table would hold for classes that have no column: the move of the state, else that which begins a phrase, else a new phrase of its own."""

    def find(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states << 21 | classes
        at = np.minimum(np.searchsorted(parser.moves, keys), len(parser.moves) - 1)
        return parser.moves[at] == keys, parser.to[at]

    on, step = find(state.astype(np.int64) // parser.k)
    begins, first = find(parser.tops[:, None])
    return np.where(on, step, np.where(begins, first, (parser.roots[:, None] << 1) + 1))


def predict(parser: Parser, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is h2 / (h1 + h2), with the two least entropies, from 0.5 on; 1 if only one language is known."""
    langs, score = ["und"] * len(texts), np.zeros(len(texts))
    asked = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
    if not asked or not parser.languages:
        return langs, score
    # In groups of a bounded size: the lanes of a group are in memory together.
    group: list[int] = []
    held = 0
    for n, i in enumerate(asked):
        group.append(i)
        held += len(texts[i])
        if held < 1 << 22 and n + 1 < len(asked):
            continue
        plain = [_plain(texts[j]) for j in group]
        entropy = phrases(parser, plain) * parser.bits / np.array([max(1, len(p)) for p in plain])[:, None]
        best = entropy.argmin(1)
        two = np.sort(entropy, 1)[:, :2]
        for j, b, h in zip(group, best, two):
            langs[j], score[j] = parser.languages[b], h[1] / (h[0] + h[1]) if len(h) > 1 else 1.0
        group, held = [], 0
    return langs, score


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for a fifth of the documents, those never learned from; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, chars: int = 60_000, passage: int = 500, total: int = 3_000_000) -> Parser:
    """Learn from documents that are not held out and have a language and a text.

    Bounded sample: the labelled texts are cut into passages of `passage` characters, of which each, wherever it lies in its text, is drawn by a hash of doc_id and its
    place with the same chance, about 2 * chars / passage for each language. `chars` characters per language are learned, or an equal share of `total` if there are more
    languages than that allows; every language is learned. Nulls and empty texts have no passages. Rows that share a doc_id share their draws; ties go by
    language and passage. The driver holds the sample and one count per language.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("chars")).collect()
    if not counts:
        return build_parser({})
    chars = max(1, min(chars, total // len(counts)))
    passage = max(1, min(passage, chars))
    wanted = 2 * -(-chars // passage)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * wanted * passage / r["chars"])) for r in counts], "lang string, share double")
    places = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / F.lit(passage)).cast("int") - 1), lambda i: F.struct(i.alias("i"), _draw(i).alias("draw")))
    drawn = usable.join(F.broadcast(shares), "lang").select("lang", "text", F.explode(F.filter(places, lambda x: x["draw"] < F.col("share"))).alias("at"))
    rows = drawn.select("lang", "at.draw", F.col("text").substr(F.col("at.i") * passage + 1, F.lit(passage)).alias("text"))
    # The expected number is half of this.
    rows = rows.orderBy("draw", "lang", "text").limit(4 * wanted * len(counts)).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["lang"], r["text"])):
        if len(samples.get(r["lang"], "")) < chars:
            samples[r["lang"]] = samples.get(r["lang"], "") + r["text"] + " "
    return build_parser({k: v[:chars] for k, v in samples.items()})


def _draw(place: Column) -> Column:
    """A number from 0 to below 1 for a passage of a document."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language"), place), 1).cast("double") / float(1 << 63)


def _told(docs: DataFrame, parser: Parser) -> DataFrame:
    """docs with a last column, of a name that docs does not use, of lang_pred and score."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            langs, score = predict(known, [t if isinstance(t, str) else None for t in b])
            yield pd.DataFrame({"lang_pred": langs, "score": score})

    return docs.withColumn(unused(docs, "told")[0], F.pandas_udf(tell, "struct<lang_pred:string,score:double>")("text"))


def identify_languages(docs: DataFrame, parser: Parser, columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns of it) with lang_pred and score appended, from the text alone.

    `und` and score 0 for a text that is null or has no letter, and for all texts if no language was learned. Repeated rows get equal
    results. A column of docs that is called lang_pred or score, in letters of either case, is replaced. Texts of any length are parsed whole; no rows give no rows.
    """
    keep = [quoted(c) for c in columns or docs.columns if c.lower() not in ("lang_pred", "score")]
    told = _told(docs, parser)
    return told.select(*keep, f"{told.columns[-1]}.lang_pred", f"{told.columns[-1]}.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is told, with all their columns: documents without a letter go. If no language can be learned, all stay that have a letter."""
    parser = train(docs)
    if not parser.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = _told(docs, parser)
    return told.where(F.col(f"{told.columns[-1]}.lang_pred") != "und").select(*columns(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out. Nulls, repeats, long and no texts as in identify_languages()."""
    docs = read_table(spark, sf_dir, "documents")
    return identify_languages(docs.select("doc_id", "text", held_out().alias("held_out")), train(docs), ["doc_id", "held_out"])
