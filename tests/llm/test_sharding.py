from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrymill.llm.sharding import KEYS, find_splitters, op2_histogram_shards, shard_rows


def shards_of(found, slack):
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {k: sum(r["w"] for r in own) for k, own in by.items()}


def test_even_and_grouped(spark):
    rows = [(i, i % 40 if i < 3000 else 99, 1 + i % 17) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, g long, w long").repartition(5).withColumn("g", F.xxhash64("g"))
    found = shard_rows(df, 8, "w", "g", "id").collect()
    assert len(found) == 6000
    sums = shards_of(found, 0)
    ideal = sum(r[2] for r in rows) / 8
    assert set(sums) == set(range(8)) and all(abs(s - ideal) <= 0.01 * ideal + 17 for s in sums.values())
    # The group that holds half of all rows is cut; most others stay whole.
    spread = defaultdict(set)
    for r in found:
        spread[r["g"]].add(r["shard"])
    assert sum(len(s) > 1 for s in spread.values()) <= 8


@pytest.mark.parametrize("hot", [0, 700])
def test_splitters_against_a_full_sort(spark, hot):
    """The weight below each splitter is within the tolerance of its target, or one row decides."""
    draw = random.Random(hot)
    rows = [(7 if i < hot else draw.randrange(-(2**63), 2**63), draw.randrange(-(2**63), 2**63), i, draw.choice([1, 5, 400])) for i in range(2_000)]
    found = find_splitters(spark.createDataFrame(rows, ", ".join(f"{k} long" for k in KEYS) + ", _weight long"), 9, 0.01)
    total = sum(r[3] for r in rows)
    assert len(found) == 8
    for j, (fixed, value) in enumerate(found, 1):
        under = lambda r: r[: len(fixed)] < fixed or r[: len(fixed)] == fixed and (value is None or r[len(fixed)] < value)  # noqa: B023, E731
        assert abs(sum(r[3] for r in rows if under(r)) - total * j / 9) <= max(0.01 * total / 9, 400)


def test_columns_of_any_name(odd):
    rows = odd.withColumn("w", F.lit(3)).withColumn("g", F.xxhash64("text"))
    found = shard_rows(rows, 4, "w", "g", "doc_id")
    assert found.columns == [c for c in rows.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert found.count() == odd.count() and found.where("_k1 = 'clash' AND _weight = 'clash' AND task = 'clash' AND row = 'clash'").count() == odd.count()


def test_rows_that_nothing_tells_apart(spark):
    df = spark.createDataFrame([(1, 5, 10)] * 100, "id long, g long, w long")
    assert set(shards_of(shard_rows(df, 4, "w", "g", "id").collect(), 0).values()) == {250}


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, 5), (2, 7, None)], "id long, g long, w long")
    assert shard_rows(df, 3, "w", "g", "id").count() == 3
    assert shard_rows(df.where("false"), 3, "w", "g", "id").count() == 0


def test_query(spark):
    found = op2_histogram_shards(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in found} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}
    total, most = sum(r["size"] for r in found), max(r["size"] for r in found)
    by = defaultdict(int)
    for r in found:
        by[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(abs(v - total / 24) <= most for v in by.values()) and len(by) == 24
