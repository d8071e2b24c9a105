"""Search hits with byte offsets, and summaries of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.content import as_latin1, constant, digest
from quarrymill.plans.compiler import found_by_automaton, gaps_and_sizes, hit_ends, may_hit, patterns_of
from quarrymill.plans.prefilter import MANY
from quarrymill.plans.ruletext import Rule


def search_hits(files: DataFrame, rules: list[Rule], key: str | None = "Addr", file_hash: str = "sha256") -> DataFrame:
    """One row per hit: pattern, start_offset, end_offset (exclusive), rule_id, file_hash, length, and the file's key and the pattern's id and ordinal.

    Hits of a pattern do not overlap and are the leftmost ones. Files with equal contents are searched once per content when key is None; then
    the key is the content's digest. Offsets are summed within the row: nothing is shuffled.
    """
    content = files.withColumn("file_hash", digest(file_hash, "content"))
    if key is None:
        content, key = content.dropDuplicates(["file_hash"]), "file_hash"
    unique = list({r.id: r for r in rules}.values())
    asked = patterns_of(unique)
    content = content.select(F.col(key).alias("file"), "file_hash", "content")
    if len(asked) >= MANY:
        may, search = found_by_automaton(F.col("view"), F.col("content"), list(asked))
        found = content.withColumn("may", may).withColumn("view", as_latin1(F.col("content"))).select("file", "file_hash", search(F.col("may")).alias("hits"))
        return placed_hits(found, unique)
    viewed = content.select("file", "file_hash", as_latin1(F.col("content")).alias("view"))
    if any(p.nocase for r in unique for p in r.patterns.values()):
        viewed = viewed.withColumn("lower", F.lower("view"))
    view, lower, wanted = F.col("view"), F.col("lower"), []
    for i, (regex, of) in enumerate(asked.items()):
        hits, needed = gaps_and_sizes(view, regex), may_hit(of[0][2], view, lower)
        wanted.append(F.struct(F.lit(i).alias("i"), (hits if needed is None else F.when(needed, hits)).alias("hits")))
    none = F.array().cast("array<struct<i:int,hits:array<struct<gap:int,size:int>>>>")
    return placed_hits(viewed.select("file", "file_hash", (F.array(*wanted) if wanted else none).alias("hits")), unique)


def placed_hits(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows of search_hits() from file, file_hash and hits: an array of struct(i, hits), i being the ordinal in patterns_of(rules)."""
    owners = [[{"rule_id": r.id, "pattern_id": k, "pattern": p.text} for r, k, p in of] for of in patterns_of(rules).values()]
    each = found.select("file", "file_hash", F.explode_outer("hits").alias("h")).where(F.size("h.hits") > 0)
    owned = each.select("file", "file_hash", F.explode(F.get(constant(owners, "array<array<struct<rule_id:string,pattern_id:string,pattern:string>>>"), F.col("h.i"))).alias("p"), "h.hits")
    placed = F.arrays_zip(hit_ends(F.col("hits")).alias("end"), F.col("hits").alias("hit"))
    each = owned.select("file", "file_hash", "p.rule_id", "p.pattern_id", "p.pattern", F.posexplode(placed).alias("nth", "at"))
    return each.select(
        "file", "rule_id", "pattern_id", "pattern", (F.col("nth") + 1).alias("nth"), (F.col("at.end") - F.col("at.hit.size")).alias("start_offset"), F.col("at.end").alias("end_offset"),
        F.col("at.hit.size").cast("long").alias("length"), "file_hash",
    )


def hit_counts(hits: DataFrame, least: int = 1) -> DataFrame:
    """Hits per file, rule and pattern, of those with `least` or more."""
    return hits.groupBy("file", "rule_id", "pattern_id").agg(F.count("*").alias("hits"), F.max("length").alias("longest"), F.min("start_offset").alias("first_offset")).where(F.col("hits") >= least)
