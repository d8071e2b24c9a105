"""Quality rules judged by host.

Each document is measured by a few rules. The failures of a rule are counted for each host, and the rates are shrunk: hosts are taken to have rates from one
beta distribution, fitted to all of them by moments, so a host with few documents stays near the mean of all and one with many keeps its own rate. The verdict
on a host says which rules it fails too often (its documents get the strict limits of these) and whether it fails one nearly always (its documents go); it is
joined back to the documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, columns, quoted, read_table, stage, unused

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules over the measures: true for a document that fails. The first two are the base rules, the others have a strict form too.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda q: q["n_words"] < 50,
    "repeated_words": lambda q: 100 * q["n_repeat_words"] > 50 * q["n_words"],
    "symbols": lambda q: 10 * q["n_symbols"] > q["n_words"],
    "repeated_lines": lambda q: 2 * q["n_dup_lines"] > q["n_lines"],
}
STRICT: dict[str, Callable[[Column], Column]] = {
    "symbols": lambda q: 50 * q["n_symbols"] > q["n_words"],
    "repeated_lines": lambda q: 10 * q["n_dup_lines"] > 3 * q["n_lines"],
}
BASE = ("few_words", "repeated_words")
#: Rates of a rule from which a host gets its strict limit, and from which its documents go: the shrunken rate less two of its standard deviations must reach them.
DOUBTED, BLOCKED = 0.3, 0.8
_WORDY = re.compile(rf"[^{BLANKS}]")


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    # A pair of ids fits a long for any text; pairs are numbered before the third word joins them.
    pairs = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)[1]
    _, window, found = np.unique(pairs.astype(np.int64) * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again, marked = found[window] > 1, np.zeros(len(words), bool)
    for k in range(3):
        marked[k : len(words) - 2 + k] |= again
    return int(marked.sum())


def measures(text: str) -> tuple[int, ...]:
    """MEASURES of a text."""
    words = text.encode(errors="surrogatepass").split()
    lines = [x for x in text.split("\n") if _WORDY.search(x)]
    blanks, symbols = sum(text.count(c) for c in BLANKS), sum(text.count(c) for c in SYMBOLS)
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([measures(t if isinstance(t, str) else "") for t in b], columns=list(MEASURES), dtype="int64")


def measured(text: Column | str) -> Column:
    """MEASURES of texts as a struct of longs; null counts as empty."""
    return F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))(text)


def host_rates(failures: DataFrame) -> DataFrame:
    """Shrunken rates by host, of failures: host, n and a column of counts for each of RULES, one row per host. Adds rate_<rule> and sure_<rule>, two posterior
    standard deviations below.

    The prior of a rule is the beta distribution with the mean of all documents and the variance between hosts that is left when the binomial part is taken off
    (by moments; none left: all hosts have the mean). A host with n documents, k of which fail, has rate (a + k) / (a + b + n). No hosts give no rows.
    """
    total = [F.sum("n").alias("docs"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("squares")]
    sums = failures.agg(*total, *[x for r in RULES for x in (F.sum(r).alias(f"k_{r}"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"s_{r}"))]).first()
    rates = {}
    for r in RULES:
        docs, mean = sums["docs"] or 1, (sums[f"k_{r}"] or 0) / (sums["docs"] or 1)
        binomial = mean * (1 - mean)
        room = docs - (sums["squares"] or 0) / docs
        between = max(0.0, ((sums[f"s_{r}"] or 0.0) - docs * mean * mean - (sums["hosts"] - 1) * binomial) / room) if room > 0 else 0.0
        if between <= 1e-12 or binomial <= between:
            strength = None if between <= 1e-12 else 0.0
        else:
            strength = binomial / between - 1
        rate = F.lit(mean) if strength is None else (F.lit(mean * strength) + F.col(r)) / (F.lit(strength) + F.col("n"))
        rates[f"rate_{r}"] = rate
        rates[f"sure_{r}"] = rate if strength is None else rate - 2 * F.sqrt(rate * (1 - rate) / (F.lit(strength) + F.col("n") + 1))
    return failures.withColumns(rates)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host, n, rate_<rule>, strict_<rule> for rules with a strict form and blocked, one row per host of rows (host, q with MEASURES). A null host is one host."""
    counts = rows.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(fails(F.col("q")).cast("long")).alias(r) for r, fails in RULES.items()])
    rated = host_rates(stage(counts, "hosts"))
    strict = [(F.col(f"sure_{r}") >= DOUBTED).alias(f"strict_{r}") for r in STRICT]
    return rated.select("host", "n", *[f"rate_{r}" for r in RULES], *strict, (F.greatest(*[F.col(f"sure_{r}") for r in RULES]) >= BLOCKED).alias("blocked"))


def _base_failed(q: Column) -> Column:
    return reduce(or_, [RULES[r](q) for r in BASE])


def _kept(q: Column, verdict: Column) -> Column:
    own = [F.when(verdict[f"strict_{r}"], STRICT[r](q)).otherwise(RULES[r](q)) for r in STRICT]
    return ~(_base_failed(q) | verdict["blocked"] | reduce(or_, own))


def _with_verdict(rows: DataFrame, verdicts: DataFrame, host: str, to: str) -> DataFrame:
    """rows with the verdict on the host in their column `host`, as a struct. A host with very many rows meets one row, so Spark can split it."""
    (of,) = unused(rows, "of")
    own = verdicts.select(F.col("host").alias(of), F.struct(*[f"strict_{r}" for r in STRICT], "blocked").alias(to))
    return rows.join(own, F.col(host).eqNullSafe(F.col(of))).drop(of)


def judge_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, host, MEASURES, base_failed and kept. Other columns of docs are ignored.

    Null texts count as empty and fail; texts of any length are measured whole. Documents without a host form one host. Repeated rows count each and get equal
    verdicts; there are no ties. No documents give no rows.
    """
    bound_batches(docs.sparkSession)
    rows = stage(docs.select("doc_id", F.col(quoted(host)).cast("string").alias("host"), measured("text").alias("q")), "measures")
    told = _with_verdict(rows, host_verdicts(rows), "host", "v")
    return told.select("doc_id", "host", "q.*", _base_failed(F.col("q")).alias("base_failed"), _kept(F.col("q"), F.col("v")).alias("kept"))


def keep_judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs without the rows that judge_documents() does not keep, with all their columns, whatever their names. Nulls, repeats, long and no texts as there.
    Texts are measured twice, which moves less than writing them."""
    bound_batches(docs.sparkSession)
    at, q, v = unused(docs, "host", "q", "v")
    told = docs.withColumns({at: F.col(quoted(host)).cast("string"), q: measured("text")})
    verdicts = host_verdicts(told.select(F.col(at).alias("host"), F.col(q).alias("q")))
    return _with_verdict(told, verdicts, at, v).where(_kept(F.col(q), F.col(v))).select(*columns(docs))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the rules and by its source as the host. Null texts fail; see judge_documents()."""
    return judge_documents(read_table(spark, sf_dir, "documents")).drop("host", "n_lines")


#: The same in SQL: hosts with their shrunken rates by moments, then the limits.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
t AS (SELECT id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS t FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, t) AS n FROM t WHERE t IS NOT NULL) WHERE n > 1),
marked AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS s(k) GROUP BY id),
q AS (SELECT id, doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d) LEFT JOIN marked USING (id)),
f AS (SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeated_words, 10 * n_symbols > n_words AS symbols, 2 * n_dup_lines > n_lines AS repeated_lines FROM q),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS k FROM (
  SELECT source, unnest(['few_words', 'repeated_words', 'symbols', 'repeated_lines']) AS rule, unnest([few_words, repeated_words, symbols, repeated_lines]) AS failed FROM f) GROUP BY ALL),
m AS (SELECT rule, sum(n) AS docs, count(*) AS hosts, sum(k) / sum(n) AS mean, sum(k * k / n) AS s, sum(n) - sum(n * n) / sum(n) AS room FROM h GROUP BY rule),
b AS (SELECT *, CASE WHEN room > 0 THEN greatest(0, (s - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / room) ELSE 0 END AS v FROM m),
c AS (SELECT *, greatest(0, mean * (1 - mean) / v - 1) AS strength FROM b),
r AS (SELECT source, rule, CASE WHEN v <= 1e-12 THEN mean ELSE p - 2 * sqrt(p * (1 - p) / (strength + n + 1)) END AS rate
  FROM (SELECT *, (mean * strength + k) / (strength + n) AS p FROM h JOIN c USING (rule))),
o AS (SELECT source, max(rate) >= 0.8 AS blocked, max(CASE WHEN rule = 'symbols' THEN rate END) >= 0.3 AS many_symbols, max(CASE WHEN rule = 'repeated_lines' THEN rate END) >= 0.3 AS many_lines
  FROM r GROUP BY source)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, few_words OR repeated_words AS base_failed,
  NOT (few_words OR repeated_words OR blocked OR CASE WHEN many_symbols THEN 50 * n_symbols > n_words ELSE symbols END OR CASE WHEN many_lines THEN 10 * n_dup_lines > 3 * n_lines ELSE repeated_lines END) AS kept
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source
"""
