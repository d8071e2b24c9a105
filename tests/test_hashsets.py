from __future__ import annotations

import hashlib

import pytest

from quarrymill.engine import Engine
from quarrymill.operators import hashsets
from quarrymill.operators.hashsets import HashSet, in_hash_set

CONTENTS = [(i, f"text {i % 700}".encode() if i % 97 else None) for i in range(2_000)]


def md5(x: bytes) -> str:
    return hashlib.md5(x).hexdigest()


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(CONTENTS, "Addr long, content binary")


@pytest.mark.parametrize("most", [hashsets.MOST_WORDS, 4])
@pytest.mark.parametrize("small", [0, 100_000])
@pytest.mark.parametrize("of", [0, 3, 400])
def test_as_a_set_of_python(spark, files, monkeypatch, small, of, most):
    """With a filter, with one that is full, beyond the largest filter, and without one."""
    monkeypatch.setattr(hashsets, "MOST_WORDS", most)
    listed = [md5(f"text {i}".encode()) for i in range(of)] + [md5(str(i).encode()) for i in range(of)]
    rows = [(f" {x.upper()} " if i % 2 else x,) for i, x in enumerate(listed + listed[:5])] + [(None,), ("no digest",), ("",)]
    hashes = HashSet(spark.createDataFrame(rows, "`the md5` string"), "md5", small=small)
    assert hashes.size == 2 * of
    for known in (True, False):
        found = in_hash_set(files, hashes, known)
        assert found.columns == ["Addr", "content"]
        assert sorted(r.Addr for r in found.collect()) == [a for a, x in CONTENTS if (x is not None and md5(x) in listed) == known]


def test_filter_tells_most_apart(spark):
    known = spark.range(50_000).selectExpr("md5(cast(id AS string)) AS md5")
    others = spark.range(20_000).selectExpr("id AS Addr", "cast(concat('x', id) AS binary) AS content")
    hashes = HashSet(known, small=0)
    at = hashsets._place(hashsets.F.col("d"), hashes.words)
    asked = others.selectExpr("md5(content) AS d").withColumn("m", hashsets._mask(hashsets.F.col("d"))).join(hashes.filter, at == hashsets.F.col("_word"))
    assert asked.where("(_bits & m) = m").count() < 600
    assert in_hash_set(others, hashes).count() == 0 and in_hash_set(others, hashes, known=False).count() == 20_000


def test_empty_files_and_repeats(spark, files):
    hashes = HashSet(spark.createDataFrame([(md5(b"text 1"),)], "md5 string"), small=0)
    assert in_hash_set(files.limit(0), hashes).count() == 0
    twice = files.union(files)
    assert in_hash_set(twice, hashes).count() == 2 * in_hash_set(files, hashes).count() > 0


def test_scan_leaves_known_files_out(spark, tmp_path):
    for name, text in (("a", "needle known"), ("b", "needle new"), ("c", "hay")):
        (tmp_path / name).write_text(text)
    known = spark.createDataFrame([(hashlib.sha256(b"needle known").hexdigest().upper(),)], "sha256 string")
    engine = Engine(spark).load_rules('rule r { grep: patterns: p = "needle" condition: any() }').without_known(known, "sha256")
    scan = engine.scan(str(tmp_path))
    assert scan.search_hits.count() == 1 and scan.rule_hits.count() == 1 and scan.hash.count() == 2
