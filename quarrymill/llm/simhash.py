"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

Fingerprints that differ in at most 2 of 64 bits agree on at least six of eight bytes. So each distinct fingerprint goes to
28 buckets, one for each choice of six bytes; fingerprints of a bucket differ in 16 bits only, so a bucket holds at most 65,536
of them, whatever the corpus. Within buckets the free bits are stored vertically, one plane of lanes for each bit;
carry-save counters add the differing bits of many pairs at once, and blocks of 64 lanes are given up once all are beyond the radius. A
bucket gives the edges of a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, read_table, slots, stage
from quarrymill.llm.components import connected_components

RADIUS = 2
FREE = list(combinations(range(8), RADIUS))
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED, SHINGLE = 42, 3
#: Fingerprints that a task compares at a time; a bucket, of 65,536 at most, is never divided.
LANES = 1 << 17


def fingerprint(text: str | None) -> int:
    """64 bits; bit i is set if over half of the shingles' XXH64 have it set. No words: 0."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip((end - size)[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)})


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three bits in each lane: sum and carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter (lowest bit first) is over the radius."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same &= counter[i]
        else:
            more |= same & counter[i]
            same &= ~counter[i]
    return more


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """Bits of n rows of bytes, stored vertically: one row of words for each bit place, a word having a bit for each of 64 lanes; one more word of zeros."""
    n, size = rows.shape
    planes = np.zeros((8 * size, 8 * (-(-n // 64) + 1)), np.uint8)
    for i in range(0, n, 8192):
        some = np.packbits(np.unpackbits(rows[i : i + 8192], axis=1, bitorder="little").T, axis=1, bitorder="little")
        planes[:, i // 8 : i // 8 + some.shape[1]] = some
    return planes.view("<u8")


def close_pairs(planes: np.ndarray, run: np.ndarray, radius: int = RADIUS, look: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes i < j of lanes of the same run whose bits differ in at most `radius` places, and in how many; run is sorted, planes as
    bit_planes() makes them. One yield holds an index at most once on each side.

    Every lane is compared with the lane `shift` further on, for all shifts: a shift of the words. Eight planes at a time go through a
    tree of carry-save adders into a vertical counter; after each `look` planes, blocks of 64 lanes of which all are beyond the radius are given up.
    """
    n, words = len(run), planes.shape[1] - 1
    reach = np.searchsorted(run, run, side="right") - np.arange(n) - 1
    for shift in range(1, int(reach.max(initial=0)) + 1):
        valid = np.zeros(8 * words, np.uint8)
        bits = np.packbits(reach >= shift, bitorder="little")
        valid[: len(bits)] = bits
        valid = valid.view("<u8")
        block = np.flatnonzero(valid)
        valid = valid[block]
        by, rest = divmod(shift, 64)
        low, high = np.minimum(block + by, words), np.minimum(block + by + 1, words)
        counter = [np.zeros(len(block), np.uint64) for _ in range(len(planes).bit_length())]
        for k in range(0, len(planes), 8):
            some = planes[k : k + 8]
            x = some[:, low] >> np.uint64(rest)
            if rest:
                x |= some[:, high] << np.uint64(64 - rest)
            x ^= some[:, block]
            ones, a = _add(counter[0], x[0], x[1])
            ones, b = _add(ones, x[2], x[3])
            twos, c = _add(counter[1], a, b)
            ones, a = _add(ones, x[4], x[5])
            counter[0], b = _add(ones, x[6], x[7])
            counter[1], d = _add(twos, a, b)
            counter[2], carry = _add(counter[2], c, d)
            for i in range(3, len(counter)):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            if (k + 8) % look == 0 and k + 8 > radius:
                keep = (~_above(counter, radius) & valid) != 0
                if not keep.all():
                    block, low, high, valid, counter = block[keep], low[keep], high[keep], valid[keep], [v[keep] for v in counter]
                if not len(block):
                    break
        if len(block):
            near = ~_above(counter, radius) & valid
            row, col = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            if len(row):
                at, bit = block[row] * 64 + col, col.astype(np.uint64)
                yield at, at + shift, sum((v[row] >> bit & np.uint64(1)).astype(np.int64) << i for i, v in enumerate(counter))


def linked(planes: np.ndarray, run: np.ndarray, radius: int) -> np.ndarray:
    """For each lane the least lane of its run that it is linked to, directly or over others."""
    label, pairs, held = np.arange(len(run)), [], 0
    for i, j, _ in close_pairs(planes, run, radius):
        pairs.append((i, j))
        held += len(i)
        if held > 1 << 20:
            unite(label, *map(np.concatenate, zip(*pairs)))
            pairs, held = [], 0
    if pairs:
        unite(label, *map(np.concatenate, zip(*pairs)))
    return label


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of every edge (i, j) the least label of what the edges join."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _forest(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    """Edges from each fingerprint to the least one it is linked to within its bucket. Sorted by table and key."""
    new = np.ones(len(fp), bool)
    new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
    run = np.cumsum(new)
    lone = new & np.append(new[1:], True)
    table, fp, run = table[~lone], fp[~lone], run[~lone]
    first, second = np.array(FREE, np.uint64)[table].T * np.uint64(8)
    bits = fp.view(np.uint64)
    values = ((bits >> first) & np.uint64(255)) | (((bits >> second) & np.uint64(255)) << np.uint64(8))
    label = linked(bit_planes(values.astype("<u2").view(np.uint8).reshape(-1, 2)), run, RADIUS)
    moved = label != np.arange(len(fp))
    return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches come sorted by bucket and key; what may be an unfinished bucket waits for more."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        held.append(tuple(b[c].to_numpy() for c in ("bucket", "key", "fp")))
        if sum(len(x[0]) for x in held) < LANES:
            continue
        table, key, fp = map(np.concatenate, zip(*held))
        last = (table == table[-1]) & (key == key[-1])
        cut = int(np.argmax(last))
        if cut:
            yield _forest(table[:cut], key[:cut], fp[:cut])
        held = [(table[cut:], key[cut:], fp[cut:])]
    if sum(len(x[0]) for x in held):
        yield _forest(*map(np.concatenate, zip(*held)))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of docs (doc_id, text).

    component_id: the smallest doc_id that is reachable over fingerprints which differ in at most 2 bits, the
    row's own included; null only if no row of the component has a doc_id. Null, empty and blank texts have fingerprint 0
    and link like any other. Repeated rows get equal results. Extra columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    marked = stage(docs.select("doc_id", "text").mapInPandas(_fingerprints, docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    keys = [F.struct(F.lit(t).alias("bucket"), F.col("fp").bitwiseAND(F.lit(_signed(~((255 << 8 * a) | (255 << 8 * b))))).alias("key")) for t, (a, b) in enumerate(FREE)]
    buckets = distinct.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.bucket", "k.key", "fp")
    edges = buckets.repartition(slots(spark), "bucket", "key").sortWithinPartitions("bucket", "key", "fp").mapInPandas(_edges, "a long, b long")
    roots = connected_components(edges)
    rooted = stage(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "named")
    # A fingerprint of a large share of all rows skews this join; `named` has one row per fingerprint, so Spark can split it.
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
