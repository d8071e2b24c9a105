"""Toxicity scores by logistic regression over hashed word features, trained with FTRL-proximal.

Features are the distinct words, word pairs and pairs with one word between (skip-grams) of the lower-cased text, hashed to
2**BITS coordinates. Each coordinate has its own learning rate; the L1 term leaves most weights at exactly zero, so the model is
a short list of coordinates and weights, at most 2**BITS of them, that is shipped to the tasks that score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, quoted, read_table, unused
from quarrymill.llm.language_id import held_out

BITS = 20
WORDS = re.compile(r"\w+")


@dataclass
class Model:
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


class Features:
    """Hashed features of texts; keeps the hashes of words it has met, up to a bound."""

    def __init__(self, remembered: int = 500_000):
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def words(self, text: str | None) -> np.ndarray:
        known, found = self.known, WORDS.findall((text or "").lower())
        if len(known) > self.remembered:
            known.clear()
        out = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            out.append(h)
        return np.array(out, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """Coordinates, repeats included."""
        h = self.words(text)
        with np.errstate(over="ignore"):
            pair = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9)
            skip = h[:-2] * np.uint64(0x27D4EB2F165667C5) + h[2:] * np.uint64(0x85EBCA77C2B2AE63)
        return (np.concatenate([h, pair, skip]) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[tuple[str | None, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.01, epochs: int = 10) -> Model:
    """Train on (text, 0 or 1), in the order given. No rows give a model that scores every text 0.5."""
    make = Features()
    coords = [np.unique(make.of(t)) for t, _ in rows]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    for _ in range(epochs):
        for x, (_, y) in zip(coords, rows):
            x = np.append(x, bias)
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            push = np.where(x == bias, 0.0, l1)
            w = np.where(np.abs(zx) > push, -(zx - np.sign(zx) * push) / ((beta + root) / alpha + l2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
    push = np.full(len(z), l1)
    push[bias] = 0.0
    w = np.where(np.abs(z) > push, -(z - np.sign(z) * push) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    kept = np.flatnonzero(w[:bias])
    return Model(float(w[bias]), kept, w[kept].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> Model:
    """Learn from labelled documents that are not held out, whole texts.

    Bounded sample: about max_rows labelled documents (3/2 of that at most, the first by the draw), drawn by a hash of doc_id; all of them if there are fewer. The
    sample, and nothing else, goes to one task, which trains in the order of the hash, so that reruns agree. Null labels are left out.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    there = usable.count()
    if not there:
        return ftrl([])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 1).cast("double") / float(1 << 63)
    drawn = usable.withColumn("draw", draw).where(F.col("draw") < max_rows / there).orderBy("draw", "doc_id", "toxic").limit(max_rows * 3 // 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", "draw").repartition(1).sortWithinPartitions("draw", "text", "toxic")
    fitted = rows.mapInPandas(_fit, "bias double, index array<long>, weight array<float>").first()
    return Model(fitted["bias"], np.array(fitted["index"], np.int64), np.array(fitted["weight"], np.float32))


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [(t, int(y)) for b in batches for t, y in zip(b["text"], b["toxic"])]
    m = ftrl(rows)
    yield pd.DataFrame({"bias": [m.bias], "index": [m.index], "weight": [m.weight]})


def score_texts(model: Model, texts: list[str | None], weights: np.ndarray, make: Features) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        x = make.of(t)
        x = np.unique(x[weights[x] != 0])
        out[i] = 1 / (1 + np.exp(-np.clip(model.bias + weights[x].sum(dtype=np.float64), -35, 35)))
    return out


def score_toxicity(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns) with score (0 to 1) and predicted (score of 0.5 or more) appended, from the whole text alone.

    Null and empty texts get the score of the bias. Repeated rows get equal results. Columns of docs called score or predicted,
    in letters of either case, are replaced. Texts of any length are scored whole; no rows give no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, make = shared.value, Features()
        weights = m.dense()
        for b in batches:
            yield pd.Series(score_texts(m, [t if isinstance(t, str) else None for t in b], weights, make))

    keep = [quoted(c) for c in columns or docs.columns if c.lower() not in ("score", "predicted")]
    (own,) = unused(docs, "score")
    told = docs.withColumn(own, F.pandas_udf(score, "double")("text"))
    return told.select(*keep, F.col(own).alias("score"), (F.col(own) >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labels that are not held out. Nulls, repeats, long and no texts as in score_toxicity()."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])
