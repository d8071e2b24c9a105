"""Packing documents into token sequences by lexical retrieval.

A document is cut into full windows and a tail. Tails are packed with tails that share their words: they are routed to shards by
their rarest token (neighbours are looked for in the tail's own shard), each shard is an inverted index with BM25 weights (document frequencies and the mean length are those of all tails),
and each seed, in turn, gets the unused neighbours with the best scores until its window is full; the last neighbour is cut where the window ends and its
rest stays in the index. So only the last window of a shard has padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, read_table, slots, stage

WINDOW = 1024
#: Expected number of tails in a shard of the index.
SHARD = 1_000
K1, B = 1.2, 0.75
#: Id that ends each document.
END = 0
#: How the vocabulary's special token is spelled.
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(ranks: str):
    """Byte-level BPE from a file of base64 tokens and ranks. The id behind the last rank is the special token, also where a text spells it."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={SPECIAL: max(table.values()) + 1})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _cutter(ranks: str, window: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # As arrays: lists of ids cost as much time as finding them.
        encode, first, made = partial(encoder(ranks).encode_to_numpy, allowed_special="all"), TaskContext.get().partitionId() << 32, 0
        none = np.array([], "<u4")
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "tail"]
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.append(encode(text) if isinstance(text, str) else none, none.dtype.type(END))
                whole = ids.tobytes()
                for at in range(0, len(ids), window):
                    tail = len(ids) - at < window
                    rows.append((doc_id, at, min(window, len(ids) - at), whole[4 * at : 4 * (at + window)], len(ids), -1 if tail else 2 * (first + made), tail))
                    made += not tail
            yield pd.DataFrame(rows, columns=names)

    return cut


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << 16, np.int64)
    for b in batches:
        for ids in b["ids"]:
            terms = np.unique(np.frombuffer(ids, "<u4"))
            if len(terms) and terms[-1] >= len(counts):
                counts = np.pad(counts, (0, int(terms[-1]) + 1 - len(counts)))
            counts[terms] += 1
    there = np.flatnonzero(counts)
    yield pd.DataFrame({"term": there, "n": counts[there]})


def _router(shared, shards: int):
    """Adds the shard of a tail, told by its rarest token; a token in more tails than fit a shard is dealt out in turn."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency, seen = shared.value, 0
        for b in batches:
            rarest = np.array([t[np.argmin(frequency[t])] for t in (np.unique(np.frombuffer(x, "<u4")) for x in b["ids"])], np.uint64)
            parts = -(-frequency[rarest.astype(np.int64)] // SHARD).astype(np.uint64)
            part = (pd.util.hash_array(b["doc_id"].to_numpy(), categorize=False) + np.arange(seen, seen + len(b), dtype=np.uint64)) % parts
            seen += len(b)
            key = pd.util.hash_array(rarest, categorize=False) ^ (part * np.uint64(0x9E3779B97F4A7C15))
            yield b.assign(shard=(pd.util.hash_array(key, categorize=False) % np.uint64(shards)).astype(np.int64))

    return route


class Index:
    """BM25 inverted index of the tails of a shard."""

    def __init__(self, tails: list[np.ndarray], frequency: np.ndarray, there: int, mean: float):
        pairs = [np.unique(t, return_counts=True) for t in tails]
        self.terms = [p[0] for p in pairs]
        term, count = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        doc = np.repeat(np.arange(len(tails)), [len(p[0]) for p in pairs])
        size = np.array([len(t) for t in tails])[doc]
        weight = np.log1p((there - frequency[term] + 0.5) / (frequency[term] + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))
        order = np.argsort(term, kind="stable")
        vocabulary, place = np.unique(term[order], return_inverse=True)
        self.doc, self.weight, self.entry, self.size = doc[order].astype(np.int32), weight[order].astype(np.float32), place.astype(np.int32), len(tails)
        self.place = [np.searchsorted(vocabulary, t) for t in self.terms]
        self.count = np.bincount(self.entry, minlength=len(vocabulary))
        self.first = np.cumsum(self.count) - self.count

    def keep(self, open_: np.ndarray) -> None:
        """Drop the postings of tails that are used up."""
        there = open_[self.doc]
        self.doc, self.weight, self.entry = self.doc[there], self.weight[there], self.entry[there]
        self.count = np.bincount(self.entry, minlength=len(self.count))
        self.first = np.cumsum(self.count) - self.count

    def scores(self, seed: int) -> np.ndarray:
        at = self.place[seed]
        first, count = self.first[at], self.count[at]
        which = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        return np.bincount(self.doc[which], self.weight[which], minlength=self.size)


def fill_windows(tails: list[np.ndarray], index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, start within it, length); each token of each tail is in exactly one."""
    start, left = np.zeros(len(tails), np.int64), np.array([len(t) for t in tails])
    indexed = len(tails)
    for seed in range(len(tails)):
        if not left[seed]:
            continue
        pieces, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        if room:
            score = np.where(left > 0, index.scores(seed) + 1e-9, 0.0)
            open_ = int((left > 0).sum())
            if open_ < 0.75 * indexed:
                index.keep(left > 0)
                indexed = open_
            asked = 8
            while room and open_:
                best = np.argpartition(-score, asked)[:asked] if asked < len(score) else np.arange(len(score))
                for j in best[np.argsort(-score[best], kind="stable")]:
                    if not room or not score[j]:
                        break
                    take = min(room, int(left[j]))
                    pieces.append((int(j), int(start[j]), take))
                    start[j] += take
                    left[j] -= take
                    room -= take
                    score[j] = 0.0
                    open_ -= 1
                asked *= 4
        yield pieces


def _packer(shared, there: int, mean: float, window: int):
    def packed(rows: list[tuple], frequency: np.ndarray, name: Iterator[int]) -> Iterator[pd.DataFrame]:
        tails = [np.frombuffer(r[2], "<u4") for r in rows]
        index, out = Index(tails, frequency, there, mean), []
        for pieces in fill_windows(tails, index, window):
            sequence, offset = next(name), 0
            for j, at, size in pieces:
                doc_id, start, _, doc_tokens = rows[j]
                out.append((doc_id, start + at, size, tails[j][at : at + size].tobytes(), doc_tokens, sequence, offset))
                offset += size
        for i in range(0, len(out), 4 * SHARD):
            yield pd.DataFrame(out[i : i + 4 * SHARD], columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency, first = shared.value, TaskContext.get().partitionId() << 32
        name = iter(range(2 * first + 1, 2 * (first + (1 << 32)), 2))
        held: list[tuple] = []
        shard = None
        for b in batches:
            for own, *row in zip(b["shard"], b["doc_id"], b["start"], b["ids"], b["doc_tokens"]):
                if own != shard and held:
                    yield from packed(held, frequency, name)
                    held = []
                shard = own
                held.append(tuple(row))
        if held:
            yield from packed(held, frequency, name)

    return pack


def pack_documents(docs: DataFrame, ranks: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is the ids of its text and END; null and empty texts are END alone. Each id lies in one piece. Only the last
    sequence of a shard is shorter than the window. Repeated rows are packed as often as they occur. Sequence ids are even for full windows of one document and
    odd for packed tails. Extra columns are ignored; an empty table gives no pieces. Very long texts are encoded whole. A row without a doc_id is packed
    with doc_id null; several such rows cannot be told apart in the result. The special token's spelling in a text is that token.
    """
    spark = docs.sparkSession
    ranks = ranks or default_ranks()
    bound_batches(spark)
    # Within this function rows without an id have the least long as theirs.
    nobody = F.lit(-(1 << 63)).cast("long")
    asked = docs.select(F.coalesce(F.col("doc_id").cast("long"), nobody).alias("doc_id"), "text")
    cut = stage(asked.mapInPandas(_cutter(ranks, window), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, tail boolean"), "cut", by="tail")
    tails = cut.where("tail").select("doc_id", "start", "ids", "doc_tokens", "length")
    there, mean = tails.agg(F.count("*"), F.avg("length")).first()
    whole = cut.where("not tail").drop("tail").withColumn("offset", F.lit(0).cast("long"))
    owner = F.nullif("doc_id", nobody)
    if not there:
        return whole.withColumn("doc_id", owner)
    # One count for each token of the vocabulary, whose size the tokenizer fixes.
    counts = tails.select("ids").mapInPandas(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(max(1 << 16, int(counts["term"].max()) + 1), np.int64)
    frequency[counts["term"]] = counts["n"]
    shared = spark.sparkContext.broadcast(frequency)
    shape = "doc_id long, start long, ids binary, doc_tokens long"
    routed = tails.drop("length").mapInPandas(_router(shared, -(-there // SHARD)), f"{shape}, shard long")
    # As many tasks as the session deals work into, whatever the number of shards: a task packs one shard after the other.
    shards = routed.repartition(slots(spark), "shard").sortWithinPartitions("shard", "doc_id", "start")
    packed = shards.mapInPandas(_packer(shared, there, float(mean), window), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(packed).withColumn("doc_id", owner)


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
