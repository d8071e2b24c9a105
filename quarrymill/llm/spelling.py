"""Groups of spelling variants: words that one inserted, deleted or replaced character turns into each other.

Pairs are found by merging errata tries. In the trie of all words a pair parts at one node; there the subtree of one word, with one character skipped or
replaced, is laid over the subtree of the other, and the pair shows as two ends that coincide. Each node has a heavy child, the one with most words; only the
light ones are laid over it (with a character replaced by the heavy one, skipped, or the heavy one inserted) and over each other, small to large: a word is in
a light subtree at most log2(words) times.

Nodes with more than `most` words are merged by the exchange: their light words become keys that meet the words by equality. What hangs below is cut into
tries of at most `most` words, each merged in one task. So no task gets a frequent prefix whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, read_table, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Runs that a word of `LEAST` characters can come from.
LEAST, OFTEN, TYPO = 6, 5, 199
LOWER = {c: c + 32 for c in range(65, 91)}
#: How many times as frequent as a word its form is.
DOMINANT = 5
#: Words of a trie that one task merges.
MOST = 4_096


def words_of(doc_id: int | None, text: str, least: int = LEAST) -> Counter[str]:
    """Words of a text and how often they occur: runs of letters in lower case, of which some lose a character by a draw from doc_id and run."""
    out: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        if len(run) < least:
            continue
        word = run if run.islower() else run.translate(LOWER)
        drawn = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
        if drawn % TYPO == 0:
            at = drawn % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word and n: the words of all texts that occur `often` times or more. Counted within each batch of a task first."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter[str] = Counter()
            for doc_id, text in zip(b["id"], b["text"]):
                if isinstance(text, str):
                    found.update(words_of(None if pd.isna(doc_id) else int(doc_id), text, least))
            yield pd.DataFrame({"word": pd.Series(list(found), dtype=object), "n": pd.Series(list(found.values()), dtype="int64")})

    # Ids as text: a column of longs with nulls would come as floats.
    told = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(count, "word string, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class _Near:
    """Per word the number of near words and the best of them: the most frequent, then the least."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.found, self.best = [0] * len(words), [-1] * len(words)

    def better(self, i: int, j: int) -> bool:
        return j < 0 or (-self.counts[i], self.words[i]) < (-self.counts[j], self.words[j])

    def add(self, i: int, j: int, n: int = 1) -> None:
        """j is near i, and so are n - 1 others that are no better."""
        self.found[i] += n
        if self.better(j, self.best[i]):
            self.best[i] = j

    def group(self, all_near: list[int]) -> None:
        first = second = -1
        for i in all_near:
            if self.better(i, first):
                first, second = i, first
            elif self.better(i, second):
                second = i
        for i in all_near:
            self.add(i, second if i == first else first, len(all_near) - 1)


def merge_trie(words: list[str], counts: list[int]) -> _Near:
    """Near words among distinct words in ascending order, by the nodes of their trie: a node is a stretch of the list."""
    near, at = _Near(words, counts), {w: i for i, w in enumerate(words)}
    nodes = [(0, len(words))]
    while nodes:
        low, high = nodes.pop()
        if high - low < 2:
            continue
        depth = _shared(words[low], words[high - 1])
        node, children, i = words[low][:depth], [], low
        while i < high:
            if len(words[i]) == depth:
                children.append(("", i, i + 1))
                i += 1
                continue
            c = words[i][depth]
            end = bisect_left(words, node + chr(ord(c) + 1), i, high)
            children.append((c, i, end))
            i = end
        heavy = max((x for x in children if x[0]), key=lambda x: x[2] - x[1])
        laid: dict[str, list[int]] = {}
        for child in children:
            c, first, end = child
            nodes.append((first, end))
            if child is heavy:
                continue
            for i in range(first, end):
                rest = words[i][depth + 1 :]
                met = [node + heavy[0] + words[i][depth:]]
                if c:
                    met.append(node + heavy[0] + rest)
                    laid.setdefault(rest, []).append(i)
                    if rest[:1] != c:
                        met.append(node + rest)
                for j in (at[w] for w in met if w in at):
                    near.add(i, j)
                    near.add(j, i)
        for same in laid.values():
            if len(same) > 1:
                near.group(same)
    return near


def _merge(b: pd.DataFrame) -> pd.DataFrame:
    b = b.sort_values("word", ignore_index=True)
    near = merge_trie(b["word"].tolist(), b["n"].tolist())
    rows = [(near.words[i], k, near.words[j], near.counts[j]) for i, (k, j) in enumerate(zip(near.found, near.best)) if k]
    return pd.DataFrame(rows, columns=["word", "n_near", "form", "form_n"], dtype=object).astype({"n_near": "int64", "form_n": "int64"})


def _prefix(length: Column) -> Column:
    return F.substring(F.col("word"), F.lit(1), length)


def _branching(words: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Words below the large nodes, by the node that their trie hangs from (at, word, n), and the light words of the large nodes (word, n, depth, c, heavy)."""
    below, light = [], []
    left = words.withColumn("at", _prefix(F.lit(0)))
    while True:
        nodes = stage(left.groupBy("at").agg(F.count("*").alias("size"), F.min("word").alias("least"), F.max("word").alias("greatest")), "nodes")
        # A large node has over `most` words, so there are at most 1/most as many of them as there are words.
        large = nodes.where(F.col("size") > most)
        below.append(left.join(F.broadcast(large.select("at")), "at", "left_anti"))
        if large.isEmpty():
            return below, light
        same = F.size(F.filter(F.sequence(F.lit(1), F.length("least")), lambda i: F.substring(F.col("least"), F.lit(1), i) == F.substring(F.col("greatest"), F.lit(1), i)))
        here = left.join(F.broadcast(large.select("at", same.alias("depth"))), "at")
        parted = stage(here.withColumn("c", F.substring(F.col("word"), F.col("depth") + 1, F.lit(1))), "parted")
        weighed = parted.where("c <> ''").groupBy("at", "c").count().groupBy("at").agg(F.max_by("c", F.struct("count", "c")).alias("heavy"))
        light.append(parted.join(F.broadcast(weighed), "at").where("c <> heavy").select("word", "n", "depth", "c", "heavy"))
        left = parted.where("c <> ''").select("word", "n", _prefix(F.col("depth") + 1).alias("at"))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near, form and form_n for each word of words (word, n; distinct) with near words: how many, and the most frequent one (ties: the least)."""
    below, light = _branching(words, most)
    told = [reduce(DataFrame.unionByName, below).groupBy("at").applyInPandas(_merge, "word string, n_near long, form string, form_n long")]
    if light:
        over = stage(reduce(DataFrame.unionByName, light), "light")
        node, rest = _prefix(F.col("depth")), F.substring("word", F.col("depth") + 2, F.length("word"))
        met = F.array_compact(
            F.array(
                F.concat(node, "heavy", F.substring("word", F.col("depth") + 1, F.length("word"))),
                F.when(F.col("c") != "", F.concat(node, "heavy", rest)),
                F.when((F.col("c") != "") & (F.substring(rest, 1, 1) != F.col("c")), F.concat(node, rest)),
            )
        )
        pairs = over.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(met).alias("word")).join(words, "word")
        both = F.explode(F.array(F.struct("word", F.col("a").alias("form"), F.col("a_n").alias("form_n")), F.struct(F.col("a").alias("word"), F.col("word").alias("form"), F.col("n").alias("form_n"))))
        told.append(pairs.select(both.alias("p")).select("p.word", F.lit(1).cast("long").alias("n_near"), "p.form", "p.form_n"))
        # Words that part at one node and go on alike differ in their character there: no more than there are letters.
        alike = over.where("c <> ''").groupBy(node.alias("node"), rest.alias("rest")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "word"))).alias("own"))
        each = alike.where(F.size("own") > 1).select(F.size("own").alias("size"), F.slice("own", 1, 2).alias("best"), F.posexplode("own").alias("place", "one"))
        form = F.when(F.col("place") == 0, F.col("best")[1]).otherwise(F.col("best")[0])
        told.append(each.select("one.word", (F.col("size") - 1).cast("long").alias("n_near"), form["word"].alias("form"), (-form["rank"]).alias("form_n")))
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form"))
    return reduce(DataFrame.unionByName, told).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.rank")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form), where no chain is a circle: the end of each word's chain, by doubling."""
    up = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        up = stage(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, dominant: int = DOMINANT, most: int = MOST) -> DataFrame:
    """One row per word of docs (doc_id, text; other columns are ignored): word, form, root, n, n_near, form_n.

    Words have `least` code points and `often` occurrences or more. A word's form is its near word with most occurrences (ties: the least in code-point order)
    if these are at least `dominant` times its own, else null; root follows the forms to the last, and is the word itself if it has none.
    Null and empty texts have no words, a null doc_id counts as empty text in the draw of lost characters, repeated rows count each, texts and words may be of
    any length. No documents give no rows.
    """
    words = stage(vocabulary(docs, least, often), "words")
    near = stage(near_words(words, most), "near")
    strong = F.col("form_n") >= dominant * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")
    )
    told = stage(told, "told")
    return told.join(roots(told.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots. Nulls, repeats, long and no texts as in spelling_variants()."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))
