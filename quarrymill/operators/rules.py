"""Evaluation of rules over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.plans.compiler import with_answers
from quarrymill.plans.ruletext import Rule


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.id, r.name) for r in rules], "id string, name string")


def join_files(dirent: DataFrame, inode: DataFrame, keys: list[tuple[str, str]] | None = None) -> DataFrame:
    """Names joined with their metadata. keys: pairs of columns; with several file systems, pass the file system's offset too,
    since addresses are unique only within one."""
    on = [dirent[a] == inode[b] for a, b in keys or [("MetaAddr", "Addr")]]
    own = [c for c in inode.columns if c not in dirent.columns]
    return dirent.join(inode, on).select(*[dirent[c] for c in dirent.columns], *[inode[c] for c in own])


def rule_hits(files: DataFrame, rules: list[Rule], metadata_only: bool = False) -> DataFrame:
    """id, path, name and addr of files for each rule that they match, without repeats.

    All rules are answered in one pass: a row gets the array of the ids whose predicates hold. metadata_only evaluates only the file_metadata
    sections. Rules with equal bodies have one id and count once.
    """
    unique = list({r.id: r for r in rules}.values())
    return answered_rules(with_answers(files, unique, metadata_only))


def answered_rules(answered: DataFrame) -> DataFrame:
    """rule_hits from files with _ids."""
    # Of explode() Spark would infer that _ids is not empty, and compute all of it once more to test that before.
    each = answered.select(F.explode_outer("_ids").alias("id"), F.col("Path").alias("path"), F.col("Name").alias("name"), F.col("Addr").alias("addr"))
    return each.where("id IS NOT NULL").distinct()


def hit_report(dirent: DataFrame, inode: DataFrame, hash_: DataFrame, hits: DataFrame) -> DataFrame:
    """Path, Name, Addr, Filesize, SHA256, rule_id, pattern_id, hits and first_offset: the exported tables joined. Hits are those of contents (their file_hash is
    a SHA-256): they are counted for each content before they meet the files that have it."""
    counted = hits.groupBy("file_hash", "rule_id", "pattern_id").agg(F.count("*").alias("hits"), F.min("start_offset").alias("first_offset"))
    named = join_files(dirent, inode.drop("Id", "Type", "Flags")).join(hash_.withColumnRenamed("MetaAddr", "of"), F.col("Addr") == F.col("of"))
    return named.join(counted, F.col("SHA256") == F.col("file_hash")).select("Path", "Name", "Addr", "Filesize", "SHA256", "rule_id", "pattern_id", "hits", "first_offset")


def files_with_hits(dirent: DataFrame, hash_: DataFrame, hits: DataFrame) -> DataFrame:
    """Directory entries of contents that have a hit, each once."""
    contents = hash_.join(hits.select("file_hash"), F.col("SHA256") == F.col("file_hash"), "left_semi").select(F.col("MetaAddr").alias("of"))
    return dirent.join(contents, F.col("MetaAddr") == F.col("of"), "left_semi")
