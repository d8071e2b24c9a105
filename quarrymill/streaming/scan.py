"""Continuous scans: files that appear in a folder are scanned in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.engine import Engine
from quarrymill.sources.files import file_columns

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 5_000) -> DataFrame:
    read = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    return file_columns(read.load(folder))


def first_seen(files: DataFrame, lifetime: str = "7 days", by: tuple[str, ...] = ("FsOffset", "Addr")) -> DataFrame:
    """A stream of files without those whose key has come before, in the same micro-batch or an earlier one: names of one file (hard links) are searched once.

    by: columns of the key; those that files lack are left out, and ValueError is raised if none is there. Nulls are equal. Which of several rows of one micro-batch stays is not
    defined. The state holds keys alone, each for `lifetime` from the time of the micro-batch that met it first, so it is bounded by what comes in that time; no file is ever too
    late. It lies in the checkpoint of the stream, so a restart does not forget it.
    """
    keys = [c for c in by if c in files.columns]
    if not keys:
        raise ValueError(f"files have none of the columns {', '.join(by)}")
    seen = "_seen_at"
    return files.withColumn(seen, F.current_timestamp()).withWatermark(seen, lifetime).dropDuplicatesWithinWatermark(keys).drop(seen)


def scan_stream(engine: Engine, files: DataFrame, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the hits of each micro-batch to OUTPUT/rule_hits/batch=N and OUTPUT/search_hits/batch=N.

    A batch that is run again after a failure overwrites what it wrote before, so each file's hits are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        scanned = engine.scan(batch)
        for name in ("rule_hits", "search_hits"):
            getattr(scanned, name).write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
