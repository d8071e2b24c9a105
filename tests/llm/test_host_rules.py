from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from quarrymill.llm.host_rules import MEASURES, OP11_SQL, host_verdicts, judge_documents, keep_judged, measured, measures, op11_host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines, again = lines + 1, again + (line in seen)
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), lines


def test_measures_against_plain_numbers(odd):
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab  \n\t\x0b#é| \x1c") for _ in range(draw.randrange(60))) for _ in range(400)]
    for t in [*texts, *[r["text"] or "" for r in odd.collect()], "a b c a b c", "a a a a", "a a a", " ".join("xyz"[i % 3] for i in range(5_000))]:
        assert measures(t) == plain(t), t[:80]


def page(draw, words=80, symbols=0, copies=0):
    text = " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(words))
    return text + " #" * symbols + "\nsame line here" * copies


@pytest.fixture(scope="module")
def hosts(table):
    """Good documents of all hosts; one host that mostly fails, one that fails a rule often, one with a single failing document, and one without a name."""
    draw, rows = random.Random(9), []
    for host in ("a", "b", "c", None):
        rows += [(page(draw), "en", host) for _ in range(60)]
    rows += [(page(draw, symbols=30), "en", "junk") for _ in range(95)] + [(page(draw), "en", "junk") for _ in range(5)]
    rows += [(page(draw, symbols=30), "en", "half") for _ in range(40)] + [(page(draw, symbols=4), "en", "half") for _ in range(30)] + [(page(draw), "en", "half") for _ in range(30)]
    rows += [(page(draw, symbols=30), "en", "single"), (page(draw, symbols=4), "en", "a"), (page(draw, words=10), "en", "a"), (None, "en", "a"), (page(draw, copies=90), "en", "a")]
    return table([(i, *r) for i, r in enumerate(rows)])


def test_verdicts_follow_shrunken_rates(hosts):
    told = {r["host"]: r for r in host_verdicts(hosts.select(hosts["source"].alias("host"), measured("text").alias("q"))).collect()}
    assert [h for h, r in told.items() if r["blocked"]] == ["junk"] and {h for h, r in told.items() if r["strict_symbols"]} - {"single"} == {"junk", "half"}
    assert told[None]["n"] == 60
    # One failing document says little of its host; many say much.
    assert 0 < told["single"]["rate_symbols"] < 1 and told["a"]["rate_symbols"] < 0.05 and told["junk"]["rate_symbols"] > 0.9


def test_documents_get_their_hosts_verdict(hosts):
    text = {r["doc_id"]: r["text"] for r in hosts.collect()}
    for r in judge_documents(hosts).collect():
        words, _, symbols, again, repeated, lines = plain(text[r["doc_id"]])
        assert tuple(r[m] for m in MEASURES) == plain(text[r["doc_id"]])
        assert r["base_failed"] == (words < 50 or 100 * repeated > 50 * words)
        limit = symbols * (50 if r["host"] == "half" else 10) > words
        assert r["kept"] == (not r["base_failed"] and r["host"] != "junk" and not limit and 2 * again <= lines)
    left = keep_judged(hosts)
    assert left.columns == hosts.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in judge_documents(hosts).where("kept").collect())


def test_odd_and_no_documents(odd, none):
    assert judge_documents(odd).count() == odd.count() and keep_judged(odd).columns == odd.columns
    assert judge_documents(none).count() == keep_judged(none).count() == 0
    assert judge_documents(odd, host="a.b").select("host").distinct().count() == 1


def test_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = op11_host_rules(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({OP11_SQL})").fetchall())
