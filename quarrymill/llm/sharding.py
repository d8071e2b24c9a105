"""Sharding by histogram sort.

Rows are ordered by a key and cut into shards at splitters. The splitters come from counting, not from
sampling: each round counts, across all partitions, the exact weight below evenly spaced candidate
boundaries, keeps for every splitter the interval that holds its target weight, and probes that interval
more finely, until a boundary lies within the tolerance of the target or the interval holds one row. Then the
rows are exchanged once, to the shards that the splitters tell.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import columns, read_table, slots, stage

#: Bits that one round of probes resolves: 4096 candidate boundaries for each open splitter.
PROBE_BITS = 12
KEYS = ("_k1", "_k2", "_k3")


@dataclass
class _Cell:
    """Interval of keys: equal to `fixed` in the first key columns, with `bits` high bits of the next equal to `prefix`."""

    fixed: tuple[int, ...]
    prefix: int
    bits: int
    below: int

    @property
    def key(self) -> Column:
        return F.col(KEYS[len(self.fixed)])

    @property
    def step(self) -> int:
        return min(PROBE_BITS, 64 - self.bits)

    def holds(self) -> Column:
        tests = [F.col(k) == F.lit(v) for k, v in zip(KEYS, self.fixed)]
        if self.bits:
            tests.append(F.shiftright(self.key, 64 - self.bits) == F.lit(self.prefix))
        return reduce(and_, tests, F.lit(True))

    def probe(self) -> Column:
        """Which of the evenly spaced parts of the interval a row lies in."""
        first = self.prefix << self.step if self.bits else -(1 << (self.step - 1))
        return (F.shiftright(self.key, 64 - self.bits - self.step) - F.lit(first)).cast("int")

    def part(self, i: int) -> int:
        return i + (self.prefix << self.step if self.bits else -(1 << (self.step - 1)))

    def edge(self, i: int) -> tuple[tuple[int, ...], int | None]:
        """Boundary before part i; None stands for the end of this key's range."""
        value = self.part(i) << (64 - self.bits - self.step)
        return self.fixed, value if value < 1 << 63 else None

    def inside(self, i: int, below: int) -> _Cell | None:
        prefix, bits = self.part(i), self.bits + self.step
        if bits < 64:
            return _Cell(self.fixed, prefix, bits, below)
        if len(self.fixed) + 1 < len(KEYS):
            return _Cell((*self.fixed, prefix), 0, 0, below)
        return None


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[tuple[int, ...], int | None]]:
    """Boundaries between `shards` intervals of nearly equal weight; rows has KEYS and `_weight`.

    The driver gets at most 4096 counts for each splitter and round; the rows stay where they are.
    """
    total = rows.agg(F.sum("_weight")).first()[0] or 0
    if not total:
        return []
    targets = {j: total * j / shards for j in range(1, shards)}
    slack = tolerance * total / shards
    found: dict[int, tuple[tuple[int, ...], int | None]] = {}
    cell_of = {j: _Cell((), 0, 0, 0) for j in targets}
    while cell_of:
        cells = list({(c.fixed, c.prefix, c.bits): c for c in cell_of.values()}.values())
        which, part = F, F
        for i, c in enumerate(cells):
            which, part = which.when(c.holds(), F.lit(i)), part.when(c.holds(), c.probe())
        counts = (
            rows.select(which.alias("cell"), part.alias("part"), "_weight")
            .where(F.col("cell").isNotNull())
            .groupBy("cell", "part")
            .agg(F.sum("_weight").alias("weight"), F.count("*").alias("n"))
            .collect()
        )
        by_cell: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["cell"], r["part"])):
            by_cell.setdefault(r["cell"], []).append(r)
        nxt = {}
        for j, c in cell_of.items():
            i = next(i for i, x in enumerate(cells) if (x.fixed, x.prefix, x.bits) == (c.fixed, c.prefix, c.bits))
            at = c.below
            for r in by_cell[i]:
                after = at + r["weight"]
                if after >= targets[j] or r is by_cell[i][-1]:
                    low, high = targets[j] - at, after - targets[j]
                    deeper = c.inside(r["part"], at) if r["n"] > 1 else None
                    if deeper is None or min(low, high) <= slack:
                        found[j] = c.edge(r["part"] + (high < low))
                    else:
                        nxt[j] = deeper
                    break
                at = after
        cell_of = nxt
    return [found[j] for j in sorted(found)]


def _at_or_above(edge: tuple[tuple[int, ...], int | None]) -> Column:
    fixed, value = edge
    test = F.lit(False) if value is None else F.col(KEYS[len(fixed)]) >= F.lit(value)
    for k, v in reversed(list(zip(KEYS, fixed))):
        test = (F.col(k) > F.lit(v)) | ((F.col(k) == F.lit(v)) & test)
    return test


def shard_rows(rows: DataFrame, shards: int, weight: str, group: str, order: str, tolerance: float = 0.002) -> DataFrame:
    """rows with `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard).

    weight: a long column; shards get nearly equal sums of it. group: a long hash; rows with one value of it
    stay together unless a splitter has to cut the group to keep the shards even. order: any column that orders
    the rows of a group. Rows alike in all three are told apart by their position. Null weights count as 0, null
    orders come first. An empty input gives no rows. Other columns may have any names; one called shard or slot is replaced. The input is read
    once; the numbering works on staged rows.

    The splitters that were found lead the exchange. A shard goes to several tasks, by a hash of the whole key, each in key order: their number is
    that of the session's shuffle partitions, and rows of one group are not all in one task.
    """
    spark = rows.sparkSession
    own = [c for c, name in zip(columns(rows), rows.columns) if name.lower() not in ("shard", "slot")]
    keyed = stage(
        rows.select(
            F.struct(*own).alias("row"),
            F.coalesce(F.col(group), F.lit(0)).cast("long").alias(KEYS[0]),
            F.xxhash64(F.col(order)).alias(KEYS[1]),
            F.monotonically_increasing_id().alias(KEYS[2]),
            F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("_weight"),
        ),
        "keyed",
    )
    edges = find_splitters(keyed, shards, tolerance)
    shard = reduce(lambda a, e: a + _at_or_above(e).cast("int"), edges, F.lit(0))
    tasks = max(1, slots(spark) // shards)
    task = F.col("shard") * tasks + F.pmod(F.xxhash64(*KEYS), F.lit(tasks)).cast("int")
    at = F.monotonically_increasing_id()
    sent = stage(
        keyed.select("row", *KEYS, shard.alias("shard"))
        .withColumn("task", task)
        .repartitionById(shards * tasks, F.col("task"))
        .sortWithinPartitions(*KEYS)
        .select("row", "shard", "task", at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")),
        "sharded",
    )
    # One row for each task.
    runs = sent.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("task").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = sent.join(F.broadcast(runs), F.col("task") == F.col("of"))
    return numbered.select("row.*", "shard", (F.col("nth") + F.col("first")).cast("long").alias("slot"))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key")
    )
    return shard_rows(rows, 24, weight="size", group="text_key", order="doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
