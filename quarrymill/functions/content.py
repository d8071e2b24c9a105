"""Columns over the bytes of files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.blake3_lanes import blake3_each


def as_latin1(content: Column | str) -> Column:
    """Bytes as text with one character per byte, so that positions are byte offsets."""
    return F.decode(content, "ISO-8859-1")


def constant(value: object, kind: str) -> Column:
    """A value (of lists, texts and numbers) as a column that Spark evaluates once for each query, however large it is."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def bound_batches(rows: int = 1_000, size: int = 32 << 20) -> None:
    """Hand Python workers of this session at most so many rows and bytes at a time. Stricter settings stay."""
    spark = SparkSession.getActiveSession()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.match(r"-?\d+", spark.conf.get(key, None) or "-1")
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hex_of(content: Column | str) -> Column:
    return F.lower(F.hex(content))


def _each(f: Callable[[list[bytes]], list[str]], content: Column) -> Column:
    """f of the contents of each Arrow batch; null stays null."""
    bound_batches()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            there = b[b.notna()]
            yield pd.Series(f([bytes(x) for x in there]), there.index, dtype=object).reindex(b.index).astype(object).where(b.notna(), None)

    return F.pandas_udf(run, "string")(content)


_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def fuzzy_digest(data: bytes) -> str:
    """Context-triggered piecewise hash: block size, and a base-64 letter for each piece, at that size and at twice that size.
    Pieces end where a rolling sum of seven bytes hits the block size."""
    block = 3
    while block * 64 < len(data):
        block *= 2
    while True:
        one, two, ended = _pieces(data, block)
        if ended >= 32 or block <= 3:
            return f"{block}:{one}:{two}"
        block //= 2


def _pieces(data: bytes, block: int) -> tuple[str, str, int]:
    """Letters of the pieces at the block size and at twice that, the tail's too, and the number of pieces that ended before the tail."""
    prime, start, mask = 0x01000193, 0x28021967, 0xFFFFFFFF
    window, s1, s2, s3 = [0] * 7, 0, 0, 0
    h1 = h2 = start
    one, two = [], []
    for n, c in enumerate(data):
        s2 = (s2 - s1 + 7 * c) & mask
        s1 = (s1 + c - window[n % 7]) & mask
        window[n % 7] = c
        s3 = (s3 << 5 & mask) ^ c
        h1, h2 = (h1 * prime & mask) ^ c, (h2 * prime & mask) ^ c
        roll = (s1 + s2 + s3) & mask
        if roll % block == block - 1 and len(one) < 63:
            one.append(_B64[h1 % 64])
            h1 = start
        if roll % (2 * block) == 2 * block - 1 and len(two) < 31:
            two.append(_B64[h2 % 64])
            h2 = start
    ended = len(one)
    if data and (s1 + s2 + s3) & mask:
        one.append(_B64[h1 % 64])
        two.append(_B64[h2 % 64])
    return "".join(one), "".join(two), ended


def digest(algorithm: str, content: Column | str) -> Column:
    """Lower-case hex digest: md5, sha1 and sha256 run in the JVM, blake3 and ssdeep in Python over Arrow batches."""
    content = F.col(content) if isinstance(content, str) else content
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "blake3": lambda c: _each(blake3_each, c), "ssdeep": lambda c: _each(lambda x: [fuzzy_digest(y) for y in x], c)}[algorithm](content)
