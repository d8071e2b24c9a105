from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from quarrymill.llm.exact_dedup import OP4_SQL, chunks_of, drop_exact_duplicates, exact_duplicates, normalised, op4_chunk_recipe_dedup


def wanted(rows):
    """Groups by brute force: rows of (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for norm, own in groups.items():
        best = min(own)
        for own_n, unknown, i in own:
            out.append((None if unknown else i, None if best[1] else best[2], len(own), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_against_brute_force(odd, bits):
    found = exact_duplicates(odd, name_bits=bits).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=repr) == wanted([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})


def test_clashing_names_do_not_join_texts(table):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "gamma."]) for _ in range(draw.choice([3, 400, 900])))) for i in range(60)]
    rows += [(100 + i, t.replace(" ", "\n")) for i, t in rows[:20]]
    found = exact_duplicates(table(rows), name_bits=2).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=repr) == wanted(rows)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz" * 3 + ".!", "éàüößñçœæîôû", "".join(map(chr, range(0x4E00, 0x9FA0, 7))), "".join(map(chr, range(0x3042, 0x3090))), "абвгдежзийклмнопрстуфхцчшщъыьэюя"])
def test_one_insertion_changes_two_chunks_at_most(spark, letters):
    """Chunks are cut by what stands there: what an edit leaves alone keeps its chunks, in any script, with and without punctuation."""
    draw = random.Random(7)
    text = "".join(draw.choice(letters) for _ in range(60_000))
    edited = ["!" + text, text[:30_000] + "q" + text[30_000:], text[:31_000] + text[31_001:], text[:-1]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([text, *edited])], "i int, text string").select("i", chunks_of(normalised()).alias("c")).orderBy("i").collect()
    whole = rows[0]["c"]
    assert len(whole) > 30 and max(map(len, whole)) < 4_096
    for r in rows[1:]:
        assert len(set(r["c"]) - set(whole)) <= 2 and len(set(whole) - set(r["c"])) <= 2


def test_filter(odd, none):
    left = drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    texts = [re.sub(r"\s", "", r["text"] or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == exact_duplicates(odd).where("kept").count()
    assert drop_exact_duplicates(none).count() == exact_duplicates(none).count() == 0


def test_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = op4_chunk_recipe_dedup(spark, "/root/testdata/sf0.001").select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({OP4_SQL})").fetchall())
