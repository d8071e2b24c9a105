"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: spark.checkpoint.dir, or the session's checkpoint folder. Where neither is set, a local master gets a
    folder of its own; on a cluster it raises ValueError, since executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrymill-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def stage(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. by: a column by whose values the files are parted, for
    readers that want the rows of one value.

    It cuts the lineage, so that neither a lost executor nor a second use recomputes what made df, and
    it fixes row ids that were given by position.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete what stage() has written in this process. Only for when no result that was made from it is read any more."""
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, rows: int = 1_000, size: int = 16 << 20) -> None:
    """Hand Python workers at most so many rows and (where Spark can count them) bytes at a time, so that their memory is bounded
    however long the texts are. Stricter settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.match(r"-?\d+", spark.conf.get(key, None) or "-1")
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def quoted(name: str) -> str:
    """A column's name for expressions, whatever characters are in it."""
    return "`{}`".format(name.replace("`", "``"))


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters are in their names."""
    return [F.col(quoted(c)) for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed so that no column of df has one of them."""
    there = {c.lower() for c in df.columns}
    mark = "_"
    while any((mark + n).lower() in there for n in names):
        mark += "_"
    return [mark + n for n in names]


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_in(text: Column | str) -> Column:
    """Number of words of a text as long; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row: a lambda variable stands for it, also inside further lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slots(spark: SparkSession) -> int:
    """Partitions to deal work into: what the session has set for shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
