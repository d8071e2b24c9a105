"""Exact deduplication by content-defined chunk recipes.

A text, white space deleted, is cut into chunks where its own content says so (after a least length, at the first sentence end or run of
marked characters), so passages shared by documents give the same chunks, with and without punctuation. A chunk is named by a 64-bit hash. The names
are verified against the bytes: chunks are deduplicated within each task, then by name, and a name that two different chunks bear
is a clash. Documents without a clash compare by their ordered list of names (the recipe); those with one also carry the
SHA-256 of every chunk. Only chunks move, each about once; the documents themselves never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import SPACE, columns, read_table, stage, unused

#: Characters that a cut looks for: about a quarter of those of a script; every fourth of ASCII and Latin letters, and a stretch of each of the others.
_LATIN = "".join(rf"\x{c:02x}" for c in (*range(0x21, 0x7F, 4), *range(0xC0, 0x100, 4)))
MARK = f"[{_LATIN}α-ηа-зא-חا-حक-ठあ-げア-ゲ一-懿가-럿]"
#: A chunk ends, from 512 characters on, behind the first sentence end or the first three such characters in a row: what stands there tells, not how far it is
#: from the text's beginning. Texts that have neither for some 3,500 characters (one character again and again, say) are cut at 4096.
CHUNK = rf"(?s).{{511,4093}}?(?:[.!?;:。！？]|{MARK}{{3}})|.{{1,4096}}"


def normalised(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def chunks_of(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def _name(chunk: Column, name_bits: int) -> Column:
    name = F.xxhash64(chunk)
    return name if name_bits == 64 else name.bitwiseAND(F.lit((1 << name_bits) - 1))


def exact_duplicates(docs: DataFrame, name_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Rows are equal when their texts are once white space is deleted; null counts as empty, so null, empty and blank
    texts form one group. The row with most code points in the original text stays; among those the smallest doc_id
    (null last); of rows that repeat a doc_id one stays. Only doc_id and text are read, other columns are
    ignored. Texts of any length are cut whole; no rows give no rows. name_bits: bits of a chunk's name; fewer than 64 are for tests of clashes.
    """
    norm = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised().alias("norm"))
    recipes = stage(
        norm.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            "n_chars",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks_of(F.col("norm")), lambda c: _name(c, name_bits)).alias("recipe"),
        ),
        "recipes",
    )
    chunks = norm.select(F.explode(chunks_of(F.col("norm"))).alias("chunk"))
    clashes = stage(
        chunks.groupBy(_name(F.col("chunk"), name_bits).alias("name")).agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most").select("name"), "clashes"
    )
    if clashes.isEmpty():
        recipes = recipes.withColumn("exact", F.lit(""))
    else:
        doubtful = recipes.select("text_sha256", F.explode("recipe").alias("name")).join(clashes, "name", "left_semi").select("text_sha256").distinct()
        spelled = norm.select(
            F.sha2("norm", 256).alias("text_sha256"), F.sha2(F.concat_ws(" ", F.transform(chunks_of(F.col("norm")), lambda c: F.sha2(c, 256))), 256).alias("exact")
        ).distinct()
        doubtful = doubtful.join(spelled, "text_sha256").distinct()
        recipes = recipes.join(doubtful, "text_sha256", "left").withColumn("exact", F.coalesce("exact", F.lit("")))
    first = F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid"))
    groups = recipes.groupBy("recipe", "exact").agg(F.count("*").alias("group_size"), first.alias("first"))
    # A recipe shared by a large share of all rows makes a skewed join; the side with one row per recipe lets Spark split it.
    return recipes.join(groups, ["recipe", "exact"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256", "n_chars"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates() drops, with all their columns, whatever their names.

    Null, empty and blank texts are one group, of which one row stays; ties go to the smallest doc_id, of rows that repeat a doc_id and text one stays; texts of any
    length are compared whole. No rows give no rows.
    """
    sha, n = unused(docs, "sha", "n")
    decided = exact_duplicates(docs)
    keys = stage(
        decided.groupBy("doc_id", F.col("text_sha256").alias(sha), F.col("n_chars").alias(n)).agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("kept").select(F.col("doc_id").alias("kept_id"), sha, n, "rows"),
        "kept",
    )
    marked = docs.withColumns({sha: F.sha2(normalised(), 256), n: F.char_length(F.coalesce("text", F.lit(""))).cast("long")}).alias("d")
    same = F.col(f"d.{sha}") == F.col(f"k.{sha}")
    kept = marked.join(keys.alias("k"), same & F.col("d.doc_id").eqNullSafe(F.col("k.kept_id")) & (F.col(f"d.{n}") == F.col(f"k.{n}")), "left_semi")
    if not keys.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", sha, n])
    return kept.select(*columns(docs))


def op4_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, also the dropped ones, with the row that stays for each. Nulls, ties, repeats, long and no texts as in exact_duplicates()."""
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("n_chars")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
