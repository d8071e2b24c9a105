"""Document fingerprints from closed syncmers.

A k-mer of words is a closed syncmer if, of the hashes of the words in it, the least stands first or last. Whether a k-mer is chosen
depends on nothing outside it, so an edit disturbs only the anchors that overlap it, and equal passages keep equal anchors wherever
they stand. A fingerprint is the anchors' codes in order of position; likeness is the share of anchors that two fingerprints have in common.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import SPACE, let, read_table, slots, stage

#: Words in a k-mer.
K = 5


def words_of(text: Column) -> Column:
    """Words of a text. The empty word at an edge of text that begins or ends with white space is dropped."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def anchors_of(text: Column, k: int = K) -> Column:
    """The closed syncmers of a text, as 32-bit codes in order of position. A text of fewer than k words has one anchor, its
    whole sequence of words; one without words has none."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def code(h: Column, i: Column) -> Column:
        return F.hash(*[F.get(h, i + j) for j in range(k)])

    def chosen(x: Column, i: Column, h: Column) -> Column:
        edge = F.least(x, F.get(h, i + (k - 1)))
        inner = F.least(*[F.get(h, i + j) for j in range(1, k - 1)])
        return (i <= F.size(h) - k) & (edge <= inner)

    def select(h: Column) -> Column:
        return F.transform(F.filter(F.transform(h, lambda x, i: F.when(chosen(x, i, h), i)), lambda i: i.isNotNull()), lambda i: code(h, i))

    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<int>")).when(F.size(h) < k, F.array(F.hash(h))).otherwise(select(h)))


def as_string(anchors: Column) -> Column:
    """Eight hexadecimal digits for each anchor, in order."""
    return F.lower(F.concat_ws("", F.transform(anchors, lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct anchors against all distinct anchors, 2 * shared / (a + b); 1 if neither text has an anchor."""
    shared, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(all_ == 0, 1.0).otherwise(2.0 * shared / all_)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the row that follows by descending doc_id, of the first row for the last.

    Null texts become empty, null doc_ids come last, and rows with one doc_id follow each other in any order. Rows are
    dealt out by ranges of doc_id, so that they move once; a doc_id (or null) that holds more than a range is dealt over as many ranges as it fills. The
    first text of each range is handed to the range before it.
    """
    spark = docs.sparkSession
    parts = parts or 4 * slots(spark)
    filled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found, rows, unnamed = filled.agg(F.percentile_approx("doc_id", shares, 100 * parts), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    often = Counter(found if parts > 1 and found else [])
    bounds = sorted(often, reverse=True)
    # Numbers of ranges: one for the rows between two bounds, behind those of the upper bound if it fills ranges of its own.
    filling = [n if n > 1 else 0 for n in (often[b] for b in bounds)]
    first = list(accumulate([1 + n for n in filling], initial=0))
    above = _bounds_at_or_above(bounds)
    spread = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    if bounds:
        at = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
        # Rows of a bound that fills ranges take those; they come behind the rows above the bound and before those under it.
        own = at(filling, above - 1)
        is_bound = (above > 0) & (at(bounds, above - 1) == F.col("doc_id")) & (own > 0)
        part = F.when(is_bound, at(first, above) - own + spread(own)).otherwise(at(first, above))
    else:
        part = F.lit(0)
    nameless = max(1, -(-unnamed * parts // max(1, rows)))
    part = F.when(F.col("doc_id").isNull(), F.lit(first[-1] + 1) + spread(F.lit(nameless))).otherwise(part)
    dealt = filled.withColumn("part", part.cast("int")).drop("row")
    if any(filling) or nameless > 1:
        # Ranges were drawn by the row's position, and are read twice: a task that runs again must not draw others.
        dealt = stage(dealt, "dealt")
    led = dealt.withColumn("follows", F.lead("text").over(Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))))
    heads = dealt.groupBy("part").agg(F.max(F.struct("doc_id", "text")).alias("head"))
    # The window over all ranges sees their numbers alone.
    along = Window.orderBy("part")
    then = heads.select("part", F.coalesce(F.lead("part").over(along), F.first("part").over(along)).alias("then"))
    heads = then.join(heads.select(F.col("part").alias("then"), F.col("head.text").alias("head")), "then").select("part", "head")
    return led.join(heads, "part").select("doc_id", "text", F.coalesce("follows", "head").alias("next_text"))


def _bounds_at_or_above(bounds: list) -> Column:
    """How many of the bounds, which descend, are not under doc_id, by halving steps."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    known = F.array(*map(F.lit, bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) >= F.col("doc_id"), at + step).otherwise(at))


def edited(text: Column, following: Column) -> Column:
    """text with its last third replaced by as many characters of the following text (or all it has)."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Anchors and fingerprint of every row of docs (doc_id, text), other columns kept; null texts are empty. Equal texts
    get equal fingerprints, empty ones the empty string. Columns called anchors or fingerprint are replaced."""
    return docs.withColumn("anchors", anchors_of(F.coalesce("text", F.lit("")))).withColumn("fingerprint", as_string(F.col("anchors")))


def match_positions(a: DataFrame, b: DataFrame, k: int = K) -> DataFrame:
    """Passages that pairs of documents share: doc_id of both, the offset between them in anchors, and the anchors that agree on it.

    a and b: doc_id and anchors. Anchors that occur more than once in a document are left out here, as they do not say where they
    stand; each document of a is to be compared with the few of b that share one of the rest.
    """

    def single(d: DataFrame, side: str) -> DataFrame:
        at = d.select(F.col("doc_id").alias(f"{side}_id"), F.posexplode("anchors").alias(f"{side}_at", "anchor"))
        return at.groupBy(f"{side}_id", "anchor").agg(F.min(f"{side}_at").alias(f"{side}_at"), F.count("*").alias("n")).where("n = 1").drop("n")

    pairs = single(a, "a").join(single(b, "b"), "anchor").where("a_id <> b_id")
    return pairs.groupBy("a_id", "b_id", (F.col("b_at") - F.col("a_at")).alias("offset")).agg(F.count("*").alias("anchors"))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read_table(spark, sf_dir, "documents")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    marked = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *[anchors_of(F.col(c)).alias(f"{c}_anchors") for c in ("text", "edited", "next_text")],
    )
    own, after, following = F.col("text_anchors"), F.col("edited_anchors"), F.col("next_text_anchors")
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", as_string(own).alias("fingerprint"), as_string(after).alias("edited_fingerprint"),
        likeness(own, after).alias("near_edited"), likeness(own, following).alias("near_next"),
    )
