"""Near copies: texts that share 0.8 or more of their distinct five-word shingles, by SimHash, compared bit-sliced, and an exact check.

A text is the set of its shingles (64-bit hashes); texts of equal sets are one node. All sets are put in one order, shingles known to be common last. Of
two sets that share 0.8 some shingle is among the first fifth of both, whatever the order, so nodes meet in groups by the equality of such a shingle;
of shingles with the same nodes one is kept. Within a group, 256-bit SimHash fingerprints are compared as bit planes (simhash.close_pairs); the
radius is so wide that a pair at 0.8 is beyond it less than once in 10**8. Other similarities have shares and a radius of their own; the lower, the more is compared. What is within it is held against the parity of the shingles in 512 places,
which bounds the difference of two sets from below. A first round confirms, by the whole sets, a spanning forest of the most alike pairs that are left; a second one
all pairs that confirmed links do not join yet. No pair of one group is written out but those that pass both tests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, columns, slots, stage
from quarrymill.llm.components import connected_components
from quarrymill.llm.simhash import LOWER, bit_planes, close_pairs, unite

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint.
BITS = 256
PARITIES = 512
#: Documents from which common shingles are learned, and how many of these at most. They only order the shingles: results do not depend on them.
SAMPLE_DOCS, MOST_COMMON = 4_000, 1 << 17
#: Rows of a group that are compared with each other at a time; larger groups become pairs of such blocks.
BLOCK = 4_096


def radius(similarity: float) -> int:
    """Bits in which the fingerprints of near copies may differ. Two sets of one size point apart by the angle whose cosine is the share of shingles that both have, and
    each bit differs with the chance of that angle in half a turn (more for small sets, by a quarter at most); six deviations are added. 84 at a similarity of 0.8."""
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(BITS, math.ceil(1.24 * BITS * chance + 6.2 * math.sqrt(BITS * chance * (1 - chance))))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles of a text, A to Z in lower case; of fewer words (or none) the whole sequence is one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    digest = xxhash.xxh3_64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words))]
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        hashes = [digest(joined[a:b]) for a, b in zip((end - size)[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist())]
    return np.unique(np.array(hashes, np.uint64)).view(np.int64)


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a bounded sample of texts have, sorted, and in how many."""
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("shingles")), 1).cast("double") / float(1 << 63)
    some = docs.where(draw < SAMPLE_DOCS / max(1, docs.count())).select("text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["text"]:
                yield pd.DataFrame({"shingle": shingle_set(text)})

    rows = some.mapInPandas(sets, "shingle long").groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toPandas()
    rows = rows.sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def first_shingles(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Those of which a set with the share `similarity` in common has at least one among its own: the first by (known frequency, hash)."""
    known, often = common
    rank = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, often[at], 0)
    return shingles[np.argsort(rank, kind="stable")[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1]]


def _sketch(shingles: np.ndarray) -> bytes:
    """SimHash fingerprint (BITS: a bit is set if over half of the shingles have it set) and parities (PARITIES: of the shingles that fall to a place).

    Two sets differ in as many shingles at least as their parities in bits.
    """
    counts, n = np.zeros(BITS, np.int64), len(shingles)
    for at in range(0, n, 255 * 64):
        some = shingles[at : at + 255 * 64].view(np.uint64)
        wide = np.empty((-(-len(some) // 255) * 255, BITS // 64), np.uint64)
        wide[len(some) :] = 0
        for i, (mix, turn) in enumerate(_MIXES):
            x = some * mix
            x ^= x >> np.uint64(turn)
            x *= _MIXES[(i + 1) % len(_MIXES)][0]
            wide[: len(some), i] = x ^ (x >> np.uint64(32))
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits.reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    fingerprint = np.packbits(2 * counts > n, bitorder="little")
    parity = np.packbits(np.bincount(shingles & (PARITIES - 1), minlength=PARITIES) & 1, bitorder="little")
    return fingerprint.tobytes() + parity.tobytes()


# Odd multipliers and shifts that spread a hash over BITS bits.
_MIXES = [(np.uint64(0x9E3779B97F4A7C15), 29), (np.uint64(0xC2B2AE3D27D4EB4F), 31), (np.uint64(0x165667B19E3779F9), 30), (np.uint64(0xD6E8FEB86659FD93), 33)]


def _groups(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows (shingle, uid, n, at) of the groups whose nodes are not all joined yet, with the root of each node and the number of blocks of the group.
    Of groups with the same nodes the one of their first shingle is left."""
    if roots is None:
        rooted = rows.withColumn("root", F.col("uid"))
    else:
        rooted = rows.drop("root", "blocks").join(roots.hint("shuffle_hash"), F.col("uid") == F.col("node"), "left").select("shingle", "uid", "n", "at", F.coalesce("root", "uid").alias("root"))
    same = [F.bit_xor(F.xxhash64("uid", F.lit(i))).alias(f"same{i}") for i in (1, 2)]
    each = rooted.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c"), F.min("at").alias("first_at"), *same).where("x < y")
    kept = each.groupBy("c", "same1", "same2").agg(F.min(F.struct("first_at", "shingle")).alias("k")).select("k.shingle", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    return stage(rooted.join(kept.hint("shuffle_merge"), "shingle"), "groups")


def _met(groups: DataFrame, nodes: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Pairs (a, b) of nodes of a group that may share enough and are not joined yet; forest: the most alike ones that join what they can join."""
    at = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("blocks")).cast("int")
    parted = groups.join(nodes.select("uid", "sketch").hint("shuffle_merge"), "uid").withColumn("block", at)
    # Every row meets each block of its group: at once if the group has one, as most have.
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parted = parted.select("shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "uid", "n", "at", "root", "block", "sketch")
    order = ["shingle", "low", "high", "uid"]
    return parted.repartition(slots(groups.sparkSession), *order[:3]).sortWithinPartitions(*order).mapInPandas(_comparer(similarity, forest), "a long, b long").distinct()


def _comparer(similarity: float, forest: bool):
    """Batches come sorted by group; what may be an unfinished group waits for more."""
    group, all_ = ("shingle", "low", "high"), ("shingle", "low", "high", "uid", "n", "at", "root", "block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for b in batches:
            sketch = np.frombuffer(b"".join(b["sketch"]), np.uint8).reshape(len(b), -1)
            held.append({c: b[c].to_numpy() for c in all_} | {"sketch": sketch})
            if sum(len(x["uid"]) for x in held) < 4 * BLOCK:
                continue
            there = _joined(held)
            last = np.logical_and.reduce([there[c] == there[c][-1] for c in group])
            cut = int(np.argmax(last))
            if cut:
                yield from _pairs({k: v[:cut] for k, v in there.items()}, similarity, forest)
            held = [{k: v[cut:] for k, v in there.items()}]
        if held:
            yield from _pairs(_joined(held), similarity, forest)

    def _joined(held: list[dict]) -> dict:
        return {k: np.concatenate([x[k] for x in held]) for k in held[0]}

    return compare


def _pairs(rows: dict[str, np.ndarray], similarity: float, forest: bool) -> Iterator[pd.DataFrame]:
    new = np.ones(len(rows["uid"]), bool)
    new[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("shingle", "low", "high")])
    lone = new & np.append(new[1:], True)
    rows = {k: v[~lone] for k, v in rows.items()}
    run = np.cumsum(new)[~lone]
    n, at, mask = rows["n"].astype(np.int64), rows["at"].astype(np.int64), np.ascontiguousarray(rows["sketch"][:, BITS // 8 :]).view(np.uint64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def most_alike(pairs: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        i, j, apart = map(np.concatenate, zip(*pairs))
        order = np.argsort(apart, kind="stable")
        i, j, apart = i[order], j[order], apart[order]
        picked = spanning_forest(len(run), i, j)
        return [(i[picked], j[picked], apart[picked])]

    for i, j, _ in close_pairs(bit_planes(rows["sketch"][:, : BITS // 8]), run, radius(similarity), look=32):
        open_ = rows["root"][i] != rows["root"][j]
        # Blocks of their own are compared where a block meets itself.
        open_ &= (rows["low"][i] == rows["high"][i]) | (rows["block"][i] != rows["block"][j])
        # The shingle is the first one in common only if enough are left behind it on both sides.
        open_ &= 1 + np.minimum(n[i] - at[i], n[j] - at[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6
        i, j = i[open_], j[open_]
        differing = np.bitwise_count(mask[i] ^ mask[j]).sum(1, dtype=np.int64)
        near = differing <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6
        i, j, apart = i[near], j[near], (differing / (n[i] + n[j]))[near]
        if not len(i):
            continue
        if forest:
            held.append((i, j, apart))
            if sum(len(x[0]) for x in held) > 1 << 20:
                held = most_alike(held)
        else:
            yield _named(rows["uid"], i, j)
    if held:
        i, j, _ = most_alike(held)[0]
        yield _named(rows["uid"], i, j)


def _named(uid: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(uid[i], uid[j]), "b": np.maximum(uid[i], uid[j])})


def spanning_forest(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the edges (i, j) of a spanning forest, earlier edges first: every tree takes the first edge that leaves it, until none does."""
    label, picked, open_ = np.arange(nodes), [], np.arange(len(i))
    while True:
        a, b = label[i[open_]], label[j[open_]]
        open_, a, b = open_[a != b], a[a != b], b[a != b]
        if not len(open_):
            return np.concatenate(picked) if picked else open_
        first = np.full(nodes, len(i))
        np.minimum.at(first, a, open_)
        np.minimum.at(first, b, open_)
        picked.append(np.unique(first[first < len(i)]))
        unite(label, i[picked[-1]], j[picked[-1]])


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left, right = (sets.select(F.col("uid").alias(side), F.col("shingles").alias(f"of_{side}")).hint("shuffle_merge") for side in "ab")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    close = shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)
    return pairs.join(left, "a").join(right, "b").where(close).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid and shingles of the wanted nodes (uid, name, least_id): texts are found by doc_id, those without one by their sets."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t) for t in b["text"]]
            yield pd.DataFrame({"name": [_name(s) for s in sets], "shingles": sets})

    # The number of wanted texts grows with the corpus: dealt out by id at every size, never broadcast.
    ids = wanted.where("least_id IS NOT NULL").select(F.col("least_id").alias("doc_id")).distinct().hint("shuffle_hash")
    texts = docs.join(ids, "doc_id", "left_semi").select("text")
    if not wanted.where("least_id IS NULL").isEmpty():
        texts = texts.union(docs.where("doc_id IS NULL").select("text"))
    # Repeated rows and rows that share an id with a wanted one fall away by the name.
    found = texts.mapInPandas(told, "name binary, shingles array<long>").join(wanted.select("name", "uid").hint("shuffle_hash"), "name")
    return stage(found.groupBy("uid").agg(F.first("shingles").alias("shingles")), "sets")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id of every row of docs (doc_id, text).

    component_id: the smallest doc_id that is reachable over texts that share `similarity` of their shingles, which lies over 0 and up to 1; null only if no row of the component has a
    doc_id. Texts without words link with each other; very long texts count whole. Repeated rows get equal results. Extra columns are ignored; no rows give no rows.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity lies over 0 and up to 1")
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    common = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t) for t in b["text"]]
            first = [first_shingles(s, common.value, similarity) for s in sets]
            yield pd.DataFrame({"doc_id": b["doc_id"], "name": [_name(s) for s in sets], "n": [len(s) for s in sets], "first": first, "sketch": [_sketch(s) for s in sets]})

    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, name binary, n int, first array<long>, sketch binary"
    marked = stage(docs.mapInPandas(mark, shape), "marked")
    distinct = marked.groupBy("name").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("sketch").alias("sketch"))
    distinct = stage(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    rows = distinct.select("uid", "n", F.posexplode("first").alias("at", "shingle")).select("shingle", "uid", "n", (F.col("at") + 1).alias("at"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle")
    groups = _groups(stage(rows.join(shared.hint("shuffle_hash"), "shingle"), "shared"), None)
    met = stage(_met(groups, distinct, similarity, forest=True), "met")
    # Every node of a pair that may share enough is in the forest, so these are all sets that are ever asked for.
    ends = met.select(F.col("a").alias("uid")).union(met.select("b")).distinct()
    sets = _sets(docs, distinct.select("uid", "name", "least_id").join(ends.hint("shuffle_hash"), "uid", "left_semi"))
    links = stage(_confirm(met, sets, similarity), "links")
    groups = _groups(groups, connected_components(links))
    if not groups.isEmpty():
        rest = _met(groups, distinct, similarity, forest=False).join(met.hint("shuffle_hash"), ["a", "b"], "left_anti")
        links = links.union(stage(_confirm(stage(rest, "rest"), sets, similarity), "links"))
    roots = connected_components(links)
    rooted = stage(distinct.join(roots, F.col("uid") == F.col("node"), "left").select("name", "least_id", F.coalesce("root", "uid").alias("root")), "rooted")
    named = stage(rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("name", "component_id"), "named")
    return marked.select("doc_id", "name").join(named, "name").select("doc_id", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, with all columns; rows without doc_id stay. A repeated row stays once."""
    found = near_copies(docs)
    stays = F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    odd = stage(ids.where("doc_id IS NOT NULL AND (NOT stays OR rows > 1)"), "odd")
    # What goes is far fewer ids than what stays. Joined by name, so that no column of docs can clash.
    rows = docs.join(odd.where("NOT stays").select("doc_id"), "doc_id", "left_anti").select(*columns(docs))
    return rows if odd.where("stays").isEmpty() else rows.dropDuplicates(["doc_id", "text"])
