"""Operators over tables of names, metadata and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.sources.staging import kept


def first_inodes(inode: DataFrame, file_system: str = "FsOffset") -> DataFrame:
    """One row per address of a file system: hard links give one inode."""
    return inode.dropDuplicates([file_system, "Addr"])


def unique_contents(files: DataFrame) -> DataFrame:
    """sha256, the least address and the number of files of each content."""
    return files.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.min("Addr").alias("first_addr"), F.count("*").alias("files"))


def exclude_known(files: DataFrame, known: DataFrame, algorithm_column: str = "md5") -> DataFrame:
    """Files whose digest is not in a table of known digests."""
    return files.join(known.select(algorithm_column).distinct(), algorithm_column, "left_anti")


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, without repeats, with the side they come from."""
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))


def full_paths(dirent: DataFrame, most_levels: int = 1 << 16, file_system: str | None = None) -> DataFrame:
    """dirent with FullPath: the names from the root joined by "/", by parent addresses (MetaAddr, ParentAddr, Name), within each file system.

    Each name gets one path, that of its own parent, so files with several names (hard links) and names without metadata (null MetaAddr) have theirs. Of a folder
    with several names the first one, by parent and name, leads the paths below it. A name whose parent is not in the table, is null or is itself is a root.
    file_system: the column that tells file systems apart; FsOffset if there is one.

    Only folders are followed. Their pointers double with each round, so depth d takes log2(d) joins. Raises ValueError if names are left
    after most_levels: no tree is so deep, their parents go in a circle.
    """
    fs = F.col(file_system or "FsOffset") if file_system or "FsOffset" in dirent.columns else F.lit(0)
    named = dirent.select(fs.alias("fs"), F.col("MetaAddr").alias("a"), F.nullif("ParentAddr", "MetaAddr").alias("up"), F.col("Name").alias("part"))
    used = named.select("fs", F.col("up").alias("a")).distinct()
    same = lambda x, y: F.col(f"{x}.fs").eqNullSafe(F.col(f"{y}.fs"))
    folders = named.alias("n").join(used.alias("u"), same("n", "u") & (F.col("n.a") == F.col("u.a")), "left_semi")
    tree = folders.groupBy("fs", "a").agg(F.min(F.struct("up", "part")).alias("first")).select("fs", "a", "first.up", "first.part")
    levels = 1
    while True:
        tree = kept(tree)
        if tree.where("up IS NOT NULL").isEmpty():
            break
        if levels >= most_levels:
            raise ValueError(f"parents go in a circle, or lie over {most_levels} levels up")
        t, above = tree.alias("t"), tree.alias("above")
        tree = t.join(above, same("t", "above") & (F.col("t.up") == F.col("above.a")), "left").select(
            "t.fs", "t.a", "above.up", F.concat_ws("/", "above.part", "t.part").alias("part")
        )
        levels *= 2
    (own,) = [c for c in ("_parent", "__parent") if c not in dirent.columns][:1]
    paths = tree.select(F.col("fs").alias(f"{own}_fs"), F.col("a").alias(f"{own}_a"), F.col("part").alias(own))
    met = dirent.join(paths, fs.eqNullSafe(F.col(f"{own}_fs")) & (F.nullif("ParentAddr", "MetaAddr") == F.col(f"{own}_a")), "left")
    return met.withColumn("FullPath", F.concat_ws("/", own, "Name")).drop(own, f"{own}_fs", f"{own}_a")


def merge_ranges(ranges: DataFrame, by: list[str], stretch: int = 1 << 20) -> DataFrame:
    """Union of half-open ranges (begin, end) within each group: overlapping and touching ones become one.

    Ranges are merged within stretches of their begin first. Then one row for each stretch says how far the stretches before it reach, and what
    begins beyond that begins a merged range. So no task gets more than a stretch of ranges or the list of stretches of a group.
    """
    cell = [*by, "cell"]
    rows = ranges.where("begin < end").select(*by, F.floor(F.col("begin") / stretch).alias("cell"), "begin", "end")
    ordered = Window.partitionBy(*cell).orderBy("begin", "end")
    before, so_far = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, 0)
    flagged = rows.withColumn("new", F.when(F.col("begin") <= F.max("end").over(before), 0).otherwise(1)).withColumn("island", F.sum("new").over(so_far))
    islands = flagged.groupBy(*cell, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    earlier = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    reach = islands.groupBy(*cell).agg(F.max("end").alias("far")).withColumn("reached", F.max("far").over(earlier)).drop("far")
    starts = islands.join(reach, cell).withColumn("starts", F.when(F.col("begin") <= F.col("reached"), 0).otherwise(1))
    begun = starts.groupBy(*cell).agg(F.sum("starts").alias("n")).withColumn("begun", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy(*cell).orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    numbered = starts.join(begun, cell).withColumn("merged", F.col("begun") + F.sum("starts").over(within))
    return numbered.groupBy(*by, "merged").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("merged")


def _rejoined(pieces: DataFrame, by: list[str], stretch: int) -> DataFrame:
    """Union of half-open ranges (begin, end) of which none lies across a multiple of `stretch`. Ranges of a stretch are merged by one sort; only those that then begin or end
    at a multiple, two for each stretch at most, can go on in the next one and are merged once more."""
    cell = [*by, "cell"]
    ordered = Window.partitionBy(*cell).orderBy("begin", "end")
    before, so_far = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = pieces.withColumn("cell", F.floor(F.col("begin") / stretch)).withColumn("new", F.when(F.col("begin") <= F.max("end").over(before), 0).otherwise(1))
    islands = kept(rows.withColumn("island", F.sum("new").over(so_far)).groupBy(*cell, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island"))
    goes_on = (F.col("begin") == F.col("cell") * stretch) | (F.col("end") == (F.col("cell") + 1) * stretch)
    along = Window.partitionBy(*by).orderBy("begin")
    edges = islands.where(goes_on).withColumn("new", F.when(F.col("begin") == F.lag("end").over(along), 0).otherwise(1)).withColumn("island", F.sum("new").over(along))
    merged = edges.groupBy(*by, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return islands.where(~goes_on).select(*by, "begin", "end").union(merged.select(*by, "begin", "end"))


def unclaimed(claimed: DataFrame, allocated: DataFrame, by: list[str], stretch: int = 256, joined: int = 4096) -> DataFrame:
    """Parts of claimed ranges (by, inum, begin, end) that no allocated range covers.

    Claims and allocated ranges are cut at multiples of `stretch` and meet by equality of the stretch: an interval join whose groups are as small as
    the stretch, not as large as a disk. Within a stretch the free parts are the gaps between allocated pieces; a claim takes those that it meets. Parts that a cut
    divides are joined again, those of a file within `joined` stretches in one group.
    """
    cell = [*by, "cell"]

    def cut(ranges: DataFrame, *more: str) -> DataFrame:
        each = ranges.where("begin < end").withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / stretch), F.floor((F.col("end") - 1) / stretch))))
        return each.select(*cell, *more, F.greatest("begin", F.col("cell") * stretch).alias("begin"), F.least("end", (F.col("cell") + 1) * stretch).alias("end"))

    # Equal pieces count once, so a piece that very many ranges claim does not make a group large.
    solid = cut(allocated).distinct()
    covered = F.max("end").over(Window.partitionBy(*cell).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    begin, end = F.col("cell") * stretch, (F.col("cell") + 1) * stretch
    gaps = solid.withColumn("from", F.coalesce(covered, begin)).withColumn("gap", F.when(F.col("from") < F.col("begin"), F.struct("from", F.col("begin").alias("to"))))
    tail = F.when(F.max("end") < end, F.array(F.struct(F.max("end").alias("from"), end.alias("to")))).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>"))
    free = gaps.groupBy(*cell).agg(F.concat(F.collect_list("gap"), tail).alias("free"))
    met = cut(claimed, "inum").join(free, cell, "left")
    whole = F.array(F.struct(F.col("begin").alias("from"), F.col("end").alias("to")))
    parts = met.withColumn("part", F.explode(F.filter(F.coalesce("free", whole), lambda x: (x["from"] < F.col("end")) & (x["to"] > F.col("begin")))))
    left = parts.select(*by, "inum", F.greatest("begin", "part.from").alias("begin"), F.least("end", "part.to").alias("end"))
    return _rejoined(left, [*by, "inum"], stretch * joined)


def run_layout(runs: DataFrame, block_size: int = 4096) -> DataFrame:
    """Where the data runs of a file lie in it (inum, nth, addr, len, flags, init_size): file_begin and file_end in bytes, disk_begin and disk_end in blocks,
    and slack, the bytes of the run behind the initialised size. Filler runs take no room in the file; sparse ones have no blocks."""
    own = F.when(F.col("flags") == "Filler", 0).otherwise(F.col("len")) * block_size
    end = F.sum(own).over(Window.partitionBy("inum").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    placed = runs.withColumn("file_end", end).withColumn("file_begin", F.col("file_end") - own)
    blocks = F.col("flags") != "Sparse"
    return placed.select(
        "inum", "nth", "file_begin", "file_end", F.when(blocks, F.col("addr")).alias("disk_begin"), F.when(blocks, F.col("addr") + F.col("len")).alias("disk_end"),
        (F.col("file_end") - F.greatest("file_begin", F.least("file_end", "init_size"))).alias("slack"),
    )
