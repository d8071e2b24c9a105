"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r = min(most, exp(multiplier[source] * size / mean size of the source)): of all rates that
give every source its target number of words, these are the closest, in relative entropy, to taking each document once. The multipliers
solve the convex dual by Newton's method. Rates depend on source and size alone, so the iterations run over exact counts of
(source, size), far fewer rows than documents. The driver holds one row per source: name, totals, target and multiplier.

Rates become whole copies by order sampling: document i takes floor(r) copies, and one more if its place, a hash divided by
the fraction that is left, lies under a threshold of its source. Counting finds the threshold that meets the source's target, and
single documents whose size fits what is still missing gain or lose a copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import columns, read_table, stage, words_in

#: One place in 2**PLACE_BITS; found PLACE_STEP bits at a time.
PLACE_BITS, PLACE_STEP = 40, 10


def reshare(totals: dict[str | None, int], weights: dict[str | None, float], share: float, most: float) -> dict[str | None, float]:
    """Targets that share `share` times all words by weight; a target stops at `most` times its source's words and the rest
    is shared by weight among the others, until none is above."""
    left, open_ = share * sum(totals.values()), set(totals)
    out: dict[str | None, float] = {}
    while open_:
        unit = left / sum(weights[k] for k in open_) if left > 0 else 0.0
        full = {k for k in open_ if weights[k] * unit >= most * totals[k]}
        if not full:
            return out | {k: weights[k] * unit for k in open_}
        out |= {k: float(most * totals[k]) for k in full}
        left -= sum(most * totals[k] for k in full)
        open_ -= full
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row per source, for a broadcast: its size is bounded by max_sources."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _rate(most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("size") / F.col("mean")))


def solve_multipliers(cells: DataFrame, targets: dict[str | None, float], totals: dict[str | None, tuple[int, int]], most: float, rounds: int = 60, tolerance: float = 1e-9) -> dict[str | None, float]:
    """Multipliers by damped Newton steps on the dual; cells: source, size (over 0), n. A source at its bound gets infinity.

    The dual of one source is convex with a kink-free gradient, words(multiplier) - target, increasing in the multiplier;
    a bracket around the root keeps each step safe where the rates are cut off at `most`.
    """
    spark = cells.sparkSession
    mean = {k: w / n for k, (w, n) in totals.items() if n}
    at = {k: 0.0 for k in mean}
    low, high = {k: -math.inf for k in mean}, {k: math.inf for k in mean}
    done = {k: math.inf for k in mean if targets[k] >= most * totals[k][0]} | {k: -math.inf for k in mean if targets[k] <= 0}
    for _ in range(rounds):
        active = [(k, mean[k], at[k]) for k in mean if k not in done]
        if not active:
            break
        tilted = cells.join(_table(spark, active, "of string, mean double, multiplier double"), F.col("source").eqNullSafe(F.col("of")))
        rate, words = _rate(most), F.col("n") * F.col("size")
        sums = (
            tilted.groupBy("of")
            .agg(F.sum(words * rate).alias("words"), F.sum(F.when(rate < most, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
            .collect()
        )
        for r in sums:
            k, gap = r["of"], r["words"] - targets[r["of"]]
            if abs(gap) <= tolerance * totals[k][0]:
                done[k] = at[k]
                continue
            if gap > 0:
                high[k] = at[k]
            else:
                low[k] = at[k]
            step = at[k] - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not low[k] < step < high[k]:
                step = (low[k] + high[k]) / 2 if math.isfinite(low[k] + high[k]) else (2 * at[k] + (1 if gap < 0 else -1))
            if step == at[k]:
                done[k] = step
            at[k] = step
    return {k: done.get(k, at[k]) for k in mean}


def mix(docs: DataFrame, weights: dict[str | None, float] | list[float], share: float, most: int = 2, seed: int = 7, max_sources: int = 100_000) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row of docs (doc_id, source, text).

    size: words of the text, null counts as 0; very long texts count whole. weights: by source, or a list that is dealt out in turn to the sources by code
    point, null (a source of its own) last. share: words to take for each word there is. most: copies of a document at
    most. Documents without words take copies 0. Rows alike in doc_id, source and size draw one place, so they are taken alike. Extra
    columns are ignored. Raises ValueError over max_sources sources: the bound of what the driver holds and
    broadcasts. Reruns agree: places are hashes of doc_id and seed.
    """
    spark = docs.sparkSession
    rows = stage(docs.select("doc_id", "source", words_in("text").alias("size")), "sizes")
    cells = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    of_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs")).take(max_sources + 1)
    if len(of_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals = {r["source"]: (r["words"], r["docs"]) for r in sorted(of_source, key=lambda r: (r["source"] is None, r["source"] or ""))}
    if isinstance(weights, list):
        weights = {k: weights[i % len(weights)] for i, k in enumerate(totals)}
    targets = reshare({k: w for k, (w, _) in totals.items()}, weights, share, most)
    filled = cells.where("size > 0")
    found = solve_multipliers(filled, targets, totals, most)

    known = _table(
        spark,
        [(k, w, float(targets[k]), w / max(n, 1) or 1.0, max(-1e300, min(1e300, found.get(k, 0.0)))) for k, (w, n) in totals.items()],
        "of string, source_size long, target double, mean double, multiplier double",
    )
    rated = rows.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, _rate(most)).otherwise(0.0))
    rated = rated.withColumn("base", F.floor("rate").cast("long")).withColumn("rest", F.col("rate") - F.col("base"))
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    # Odds of the draw against the fraction left: under 1/2 for documents that plain rounding by the draw would take.
    odds = draw / (draw + F.col("rest"))
    rated = rated.withColumn("place", F.when(F.col("rest") > 0, F.least(F.floor(odds * float(1 << PLACE_BITS)), F.lit((1 << PLACE_BITS) - 1))).cast("long"))

    limits = _thresholds(rated, targets)
    marks = _table(spark, [(k, v) for k, v in limits.items()], "of string, under long")
    taken = rated.join(marks, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    taken = taken.withColumn("copies", F.col("base") + F.when(F.col("place") < F.coalesce("under", F.lit(0)), 1).otherwise(0))
    taken = stage(taken.select("doc_id", "source", "size", "source_size", "target", "rate", "copies"), "copies")
    return _fit(taken, targets, most).withColumn("taken", F.col("copies") * F.col("size"))


def _thresholds(rated: DataFrame, targets: dict[str | None, float]) -> dict[str | None, int]:
    """For each source the place under which documents take one more copy; exact counts, PLACE_STEP bits at a time."""
    spark = rated.sparkSession
    base = {r["source"]: r["words"] for r in rated.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("words")).collect()}
    need = {k: targets[k] - w for k, w in base.items()}
    below, prefix = {k: 0 for k in need}, {k: 0 for k in need}
    for bits in range(PLACE_STEP, PLACE_BITS + 1, PLACE_STEP):
        cell = F.shiftright("place", PLACE_BITS - bits)
        active = _table(spark, [(k, prefix[k]) for k in need], "of string, prefix long")
        counts = (
            rated.where("place is not null")
            .join(active, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("place", PLACE_BITS - bits + PLACE_STEP) == F.col("prefix")))
            .groupBy("of", cell.alias("cell"))
            .agg(F.sum("size").alias("words"))
            .collect()
        )
        by: dict[str | None, list] = {}
        for r in sorted(counts, key=lambda r: r["cell"]):
            by.setdefault(r["of"], []).append(r)
        for k in need:
            prefix[k] <<= PLACE_STEP
            at = below[k]
            for r in by.get(k, []):
                # The last round takes the cell whole or not, whichever comes nearer.
                if at + (r["words"] / 2 if bits == PLACE_BITS else r["words"]) > need[k]:
                    prefix[k] = r["cell"]
                    break
                at += r["words"]
            else:
                prefix[k] = (prefix[k] | ((1 << PLACE_STEP) - 1)) + (bits == PLACE_BITS)
                if by.get(k) and bits < PLACE_BITS:
                    prefix[k] = by[k][-1]["cell"]
                    at -= by[k][-1]["words"]
            below[k] = at
    return prefix


def _fit(taken: DataFrame, targets: dict[str | None, float], most: int, rounds: int = 3) -> DataFrame:
    """Give or take one copy of the document whose size is nearest to what a source lacks or has too much."""
    spark = taken.sparkSession
    changed: dict[tuple, int] = {}
    sums = {r["source"]: r["words"] for r in taken.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).collect()}
    for _ in range(rounds):
        gaps = {k: targets[k] - w for k, w in sums.items() if abs(targets[k] - w) >= 1}
        if not gaps:
            break
        wanted = _table(spark, [(k, float(g)) for k, g in gaps.items()], "gap_of string, gap double")
        now = _apply(taken, changed)
        can = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        best = F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("off"), F.xxhash64("doc_id").alias("draw"), "doc_id", "size"))
        picks = now.join(wanted, F.col("source").eqNullSafe(F.col("gap_of"))).where(can & F.col("doc_id").isNotNull()).groupBy("gap_of").agg(best.alias("b"), F.count("*")).collect()
        for r in picks:
            k, b = r["gap_of"], r["b"]
            if b["off"] < abs(gaps[k]):
                one = 1 if gaps[k] > 0 else -1
                changed[k, b["doc_id"], b["size"]] = changed.get((k, b["doc_id"], b["size"]), 0) + one
                sums[k] += one * b["size"]
    return _apply(taken, changed)


def _apply(taken: DataFrame, changed: dict[tuple, int]) -> DataFrame:
    if not changed:
        return taken
    id_type = dict(taken.dtypes)["doc_id"]
    moves = _table(taken.sparkSession, [(*k, v) for k, v in changed.items()], f"m_source string, m_id {id_type}, m_size long, m_copies long")
    same = F.col("source").eqNullSafe(F.col("m_source")) & (F.col("doc_id") == F.col("m_id")) & (F.col("size") == F.col("m_size"))
    return taken.join(moves, same, "left").withColumn("copies", F.col("copies") + F.coalesce("m_copies", F.lit(0))).drop("m_source", "m_id", "m_size", "m_copies")


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it. Rows alike in doc_id, source and size share the copies of one."""
    copies = mixed.where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").cast("int").alias("copies")).alias("m")
    marked = docs.select(F.struct(*columns(docs)).alias("row"), words_in("text").alias("words")).alias("d")
    same = F.col("d.row.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.row.source").eqNullSafe(F.col("m.source")) & (F.col("d.words") == F.col("m.size"))
    each = marked.join(copies, same).select("d.row", F.explode(F.sequence(F.lit(1), F.col("m.copies"))).alias("copy"))
    return each.select("row.*")


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), [3.0, 1.0, 2.0], share=1.5).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
