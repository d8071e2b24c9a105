"""Files held against tables of very many digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.content import digest
from quarrymill.sources.staging import kept

#: Bits of the filter for each digest, and the most words of 64 bits that it may have: 2^20 rows of two longs are about 40 MB where they are broadcast.
BITS, MOST_WORDS = 16, 1 << 20


def _place(hex_digest: Column, words: int) -> Column:
    """The word of the filter that a digest belongs to; words is a power of two."""
    return F.xxhash64(hex_digest).bitwiseAND(F.lit(words - 1))


def _mask(hex_digest: Column) -> Column:
    """Four bits of the word, by bits of the hash that do not tell the word."""
    bits = [F.shiftrightunsigned(F.xxhash64(hex_digest), 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits])


class HashSet:
    """A set of hex digests of one algorithm, with what makes it quick to ask: its size, and a Bloom filter if it is too large to be broadcast.

    digests: a table; column names the digests' column (the algorithm's, else the only one). Case, white space around a digest, repeats and nulls do not matter; what
    is no hex digest equals no file's. small: up to so many digests the set itself is broadcast.

    The set is written to the shared folder once. The filter is made by an aggregation by word, and never passes through the driver's Python.
    """

    def __init__(self, digests: DataFrame, algorithm: str = "md5", column: str | None = None, small: int = 100_000):
        self.algorithm = algorithm
        column = column or next((c for c in digests.columns if c.lower() == algorithm), digests.columns[0])
        cleaned = F.lower(F.trim(F.col("`{}`".format(column.replace("`", "``")))))
        self.digests = kept(digests.select(cleaned.alias("_known")).where("_known RLIKE '^[0-9a-f]{32,}$'").distinct())
        self.size = self.digests.count()
        self.words, self.filter = 0, None
        if small < self.size <= 16 * MOST_WORDS:
            self.words = min(MOST_WORDS, 1 << max(0, (self.size * BITS // 64 - 1).bit_length()))
            known = F.col("_known")
            self.filter = kept(self.digests.groupBy(_place(known, self.words).alias("_word")).agg(F.bit_or(_mask(known)).alias("_bits")))
        self.is_small = self.size <= small


def in_hash_set(files: DataFrame, hashes: HashSet, known: bool = True) -> DataFrame:
    """Files (with `content`) whose digest is in the set, or those whose digest is not; columns and repeats of files stay as they are. A file without content (null) is in no set.

    A small set is broadcast, and files do not move. Else its filter is: files that cannot be in the set are told apart where they are read, and only the rest, those in
    the set and about one in a hundred of the others, are exchanged by digest. Sets of over 16 million digests fill the largest filter, so all files are exchanged.
    The join decides, so results are exact whatever the filter says.
    """
    names = [F.col("`{}`".format(c.replace("`", "``"))) for c in files.columns]
    digested = files.withColumn("_digest", digest(hashes.algorithm, "content"))
    match = F.col("_digest") == F.col("_known")
    how = "left_semi" if known else "left_anti"
    if hashes.is_small:
        return digested.join(F.broadcast(hashes.digests), match, how).select(*names)
    if hashes.filter is None:
        return digested.join(hashes.digests, match, how).select(*names)
    marked = digested.join(F.broadcast(hashes.filter), _place(F.col("_digest"), hashes.words) == F.col("_word"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(_mask(F.col("_digest"))) == _mask(F.col("_digest")), F.lit(False))
    found = marked.where(maybe).join(hashes.digests, match, how).select(*names)
    return found if known else marked.where(~maybe).select(*names).union(found)
