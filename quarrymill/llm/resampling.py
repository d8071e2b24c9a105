"""Importance resampling toward a target: documents whose hashed n-grams look like those of a target are drawn with greater weight.

One scan of a text keeps a ring of running CRC-32 states, one for each of the last n words that a feature can start with. A word extends each state by a space
and its bytes, and each state then is the hash of a feature; no feature is ever spelled out. A bucket's gain compares its share in the target with its share in
all documents; a document's weight is the sum over its features. The draw adds Gumbel noise from a hash of doc_id and takes the highest scores, which is a
draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, read_table, slots, stage

#: Bytes of words: digits, lower-case letters and all beyond ASCII; the others part words.
PARTED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="surrogatepass").lower().translate(PARTED).split()


def hashes(words: list[bytes], n: int) -> Iterator[int]:
    """CRC-32 of every run of 1 to n consecutive words, joined by a space, by the word that it ends with."""
    ring: list[int] = []
    for w in words:
        after = b" " + w
        ring = [crc32(after, state) for state in ring[1 - n :]] if n > 1 else []
        ring.append(crc32(w))
        yield from ring


def _features(text: str | None, n: int, buckets: int) -> tuple[int, np.ndarray]:
    words = words_in(text)
    size = sum(max(0, len(words) - k) for k in range(n))
    return len(words), (np.fromiter(hashes(words, n), np.int64, size) % buckets)


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features of all texts (column text) by bucket. Each task adds its own up; the driver gets one number per bucket."""
    bound_batches(texts.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b["text"]:
                total += np.bincount(_features(t if isinstance(t, str) else None, n, buckets)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": there, "n": total[there]})

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares, each bucket counted once more than it occurs; rounded down."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + buckets) / ((int(s) + 1) * (t_all + buckets)))) for s, t in zip(source, target)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs. gains has one number per bucket."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for b in batches:
            rows = []
            for t in b:
                words, found = _features(t if isinstance(t, str) else None, n, len(g))
                rows.append((words, len(found), int(g[found].sum())))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")

    each = docs.select("doc_id", F.pandas_udf(told, "n_words long, n_features long, weight long")("text").alias("w"))
    return each.select("doc_id", "w.*")


def ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, score) with rank: 1 for the highest score, ties by doc_id (null last). Ranges of ranks are dealt to tasks, so none sorts all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = rows.repartitionByRange(slots(rows.sparkSession), *order).sortWithinPartitions(*order)
    # The id of a row tells its task and its place there; written, so that a task that runs again changes neither.
    placed = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, sizes = {}, placed.groupBy(task.alias("task")).count().orderBy("task").collect()
    for i, r in enumerate(sizes):
        before[r["task"]] = sum(x["count"] for x in sizes[:i])
    if not before:
        return placed.drop("_at").withColumn("rank", F.lit(None).cast("long"))
    start = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    return placed.withColumn("rank", start[task] + place + 1).drop("_at")


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score and rank, which is null unless the document is drawn.

    Of the documents with least_words words or more, percent per cent are drawn, rounded down. target has a column text. Null and empty texts have no features
    and weight 0; texts are read whole, of any length; a null doc_id counts as empty text in the draw and comes last among ties; repeated rows have a rank each.
    No documents give no rows; an empty target makes all buckets equally likely there. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = stage(weigh(docs, gains, n).withColumn("score", F.col("weight") + noise), "scored")
    may = scored.where(F.col("n_words") >= least_words)
    quota = percent * may.count() // 100
    first = ranked(may).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return first.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn toward the benchmark, by single words. Nulls, repeats, ties, long and no texts as in resample()."""
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return resample(docs, target, n=1).select("doc_id", "n_features", "weight", "score", "rank")
