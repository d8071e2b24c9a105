"""Search of large files in byte ranges.

A file is cut into ranges that several tasks search; a hit belongs to the range in which it starts and may end beyond it. Hits do not overlap, so where one
ends beyond its range the next range is searched from there: ranges whose search began at the wrong byte are searched again, until none is left. The
hits are those of a search of the whole file, and no row holds a file's content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions.content import constant
from quarrymill.plans.compiler import patterns_of
from quarrymill.plans.ruletext import Rule
from quarrymill.sources.staging import kept

#: Bytes of a range, and how many beyond its end are read at first. Patterns whose hits have a greatest size have these read instead.
RANGE, AHEAD = 32 << 20, 1 << 20
#: Bytes before a range that edges of words and the like look at.
BEFORE = 8
_RESULT = "path string, length long, nth long, start long, end long, i int, entry long, leave long, hits array<struct<begin:bigint,end:bigint>>"


def file_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, length, nth, start and end of the ranges of all files under a folder; contents are not read. Empty files have none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    each = listed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))))
    return each.select("path", "length", "nth", (F.col("nth") * size).alias("start"), F.least("length", (F.col("nth") + 1) * size).alias("end"))


def _open(path: str):
    """An open file of any file system that pyarrow knows; names of Hadoop's file systems are understood."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    fs, at = FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    return fs.open_input_file(at)


def _searcher(regexes: list[str], ahead: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(x.encode("latin-1"), re.S) for x in regexes]
        widest = [re._parser.parse(x.encode("latin-1"), re.S).getwidth()[1] for x in regexes]
        # What a hit may need beyond the range: its greatest size, if there is one of note.
        needed = [w if w < 1 << 20 else ahead for w in widest]
        for b in batches:
            for r in b.itertuples(index=False):
                rows = []
                with _open(r.path) as source:
                    base = max(0, r.start - BEFORE)
                    stop = min(r.length, r.end + max(needed[t["i"]] for t in r.todo) + 2)
                    data = source.read_at(stop - base, base)
                    for t in r.todo:
                        hits, pos = [], t["entry"] - base
                        while base + pos < r.end:
                            m = compiled[t["i"]].search(data, pos)
                            # A hit that reaches the end of what was read may go on, and an end of text there is none.
                            if m is not None and stop < r.length and base + m.end() >= stop - 1:
                                more = source.read_at(min(r.length - stop, len(data)), stop)
                                data, stop = data + more, stop + len(more)
                                continue
                            if m is None or base + m.start() >= r.end:
                                break
                            pos = m.end()
                            hits.append({"begin": base + m.start(), "end": base + pos})
                        rows.append((r.path, r.length, r.nth, r.start, r.end, t["i"], t["entry"], max(r.end, hits[-1]["end"] if hits else t["entry"]), hits))
                yield pd.DataFrame(rows, columns=["path", "length", "nth", "start", "end", "i", "entry", "leave", "hits"])

    return search


def search_ranges(spark: SparkSession, path: str, rules: list[Rule], size: int = RANGE, ahead: int = AHEAD) -> DataFrame:
    """One row per hit in the files under a folder: path, rule_id, pattern_id, pattern, nth, start_offset, end_offset, length.

    Hits are the leftmost ones and do not overlap, as in search_hits(). A pattern whose hits have no greatest size is read `ahead` bytes beyond a range,
    and on for as long as a hit reaches the end of what was read. A task holds one range at a time.
    """
    rules = list({r.id: r for r in rules}.values())
    asked = patterns_of(rules)
    if not asked:
        return spark.createDataFrame([], "path string, rule_id string, pattern_id string, pattern string, nth long, start_offset long, end_offset long, length long")
    search = _searcher(list(asked), ahead)
    ranges = file_ranges(spark, path, size)
    first = ranges.withColumn("todo", F.transform(constant(list(range(len(asked))), "array<int>"), lambda i: F.struct(i.alias("i"), F.col("start").alias("entry"))))
    # A range is work for a task of its own, or nearly.
    dealt = first.repartition(max(1, min(first.count(), 10_000)), "path", "nth")
    found = kept(dealt.mapInPandas(search, _RESULT))
    key = ["path", "nth", "i"]
    before = Window.partitionBy("path", "i").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        due = found.drop("hits").withColumn("due", F.greatest("start", F.max("leave").over(before)))
        wrong = kept(due.where("due <> entry"))
        if wrong.isEmpty():
            break
        again = wrong.groupBy("path", "length", "nth", "start", "end").agg(F.collect_list(F.struct("i", F.col("due").alias("entry"))).alias("todo"))
        right = found.join(wrong.select(key), key, "left_anti").select(found.columns)
        found = kept(right.unionByName(again.mapInPandas(search, _RESULT)))
    counted = found.select(*key, F.coalesce(F.sum(F.size("hits")).over(before), F.lit(0)).alias("earlier"))
    owners = [[{"rule_id": r.id, "pattern_id": k, "pattern": p.text} for r, k, p in of] for of in asked.values()]
    each = found.where(F.size("hits") > 0).join(counted, key).select("path", "i", "earlier", F.posexplode("hits").alias("at", "hit"))
    owned = each.withColumn("p", F.explode(F.get(constant(owners, "array<array<struct<rule_id:string,pattern_id:string,pattern:string>>>"), F.col("i"))))
    return owned.select(
        "path", "p.rule_id", "p.pattern_id", "p.pattern", (F.col("earlier") + F.col("at") + 1).alias("nth"), F.col("hit.begin").alias("start_offset"), F.col("hit.end").alias("end_offset"),
        (F.col("hit.end") - F.col("hit.begin")).alias("length"),
    )
