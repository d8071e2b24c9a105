"""Sources of files: folders, corpora in Parquet, and prepared listings of file systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.labels import META_FLAGS, NAME_FLAGS, NAME_TYPES, flag_labels, format_timestamp, label_of, up_to_nul

_S, _L = T.StringType(), T.LongType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


DIRENT = _schema(Id=_S, Path=_S, Name=_S, ShortName=_S, Type=_S, Flags=_S, MetaAddr=_L, ParentAddr=_L, MetaSeq=_L, ParentSeq=_L)
INODE = _schema(
    Id=_S, Type=_S, Flags=_S, Addr=_L, FsOffset=_L, Filesize=_L, Uid=_L, Gid=_L, LinkTarget=_S, NumLinks=_L, SeqNum=_L, Created=_S, Accessed=_S, Modified=_S, Metadata=_S
)
HASH = _schema(MetaAddr=_L, MD5=_S, SHA1=_S, SHA256=_S, Blake3=_S, Ssdeep=_S)
RULES = _schema(id=_S, name=_S)
RULE_HITS = _schema(id=_S, path=_S, name=_S, addr=_L)
SEARCH_HITS = _schema(pattern=_S, start_offset=_L, end_offset=_L, rule_id=_S, file_hash=_S, length=_L)


def open_source(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder (in any file system that Spark reads). Raises FileNotFoundError if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"Couldn't open source {path}")
    return directory_files(spark, path)


def directory_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, Name, Type, Flags, Addr, Filesize, Modified, Created and content of every file under a folder.

    Addr is a hash of the full path: folders of object stores have no addresses. Created is not known and is the time of change.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return file_columns(read)


def file_columns(read: DataFrame) -> DataFrame:
    """Columns of files from Spark's binaryFile columns, of a batch or a stream."""
    changed = F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss")
    return read.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("Path"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("Name"),
        F.lit("File").alias("Type"),
        F.lit("Allocated").alias("Flags"),
        F.abs(F.xxhash64("path")).alias("Addr"),
        F.col("length").alias("Filesize"),
        changed.alias("Modified"),
        changed.alias("Created"),
        "content",
    )


def folders_of(files: DataFrame) -> DataFrame:
    """One row per folder that holds files, directly or below: Path of the folder above, Name, Type."""
    parts = F.split("Path", "/")
    each = files.select("Path").distinct().select(parts.alias("parts")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))).alias("full"))
    each = each.distinct().where("full <> ''")
    return each.select(F.regexp_replace("full", "/?[^/]*$", "").alias("Path"), F.regexp_extract("full", "([^/]*)$", 1).alias("Name"), F.lit("Folder").alias("Type"))


def folders_below(files: DataFrame, root: str) -> DataFrame:
    """The folders under a folder that hold files, as files without content: columns of directory_files. Empty folders are not seen."""
    full = F.concat_ws("/", "Path", "Name")
    below = folders_of(files).where(full.startswith(root.rstrip("/") + "/"))
    empty = [F.lit("Allocated").alias("Flags"), F.abs(F.xxhash64(full)).alias("Addr"), F.lit(0).cast("long").alias("Filesize"), F.lit("").alias("Modified"), F.lit("").alias("Created")]
    return below.select("Path", "Name", "Type", *empty, F.lit(None).cast("binary").alias("content"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers spell it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def full_table(rows: DataFrame, schema: T.StructType, given: dict[str, Column]) -> DataFrame:
    """rows in a schema: given columns, columns of rows by name, else empty text or 0."""
    there = {c.lower() for c in rows.columns}
    empty = lambda t: F.lit("") if t == _S else F.lit(0)
    return rows.select(*[given.get(f.name, F.col(f.name) if f.name.lower() in there else empty(f.dataType)).cast(f.dataType).alias(f.name) for f in schema.fields])


#: Times that only some kinds of file systems keep: column to prefix of its seconds and nanos.
OWN_TIMES = {"NTFS": {"FnCreated": "fn_created", "FnAccessed": "fn_accessed", "FnModified": "fn_modified", "FnMetadata": "fn_metadata"}, "EXT": {"Deleted": "deleted"}, "HFS": {"Backup": "backup"}}


def own_times(metas: DataFrame, kind: str = "fs_type") -> DataFrame:
    """metas with the times of OWN_TIMES as text: null if the file system in `kind` does not keep one, or it is 0."""
    added = {n: F.when(F.col(kind).startswith(k), F.nullif(format_timestamp(F.col(f"{t}_s"), F.col(f"{t}_ns")), F.lit(""))) for k, names in OWN_TIMES.items() for n, t in names.items()}
    return metas.withColumns(added)


def corpus_files(documents: DataFrame) -> DataFrame:
    """A table of texts (doc_id, text, lang, source) as files."""
    text = F.coalesce("text", F.lit(""))
    day = lambda step: format_timestamp(F.lit(1_672_531_200) + F.col("doc_id") * step, F.lit(0))
    return documents.select(
        F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("Path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("Name"),
        F.lit("File").alias("Type"),
        F.lit("Allocated").alias("Flags"),
        F.col("doc_id").alias("Addr"),
        F.octet_length(text).cast("long").alias("Filesize"),
        day(3_601).alias("Created"),
        day(7_203).alias("Modified"),
        text.cast("binary").alias("content"),
    )


def page_files(pages: DataFrame) -> DataFrame:
    """A table of web pages (page_id, url, html) as files."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.lit("/pages").alias("Path"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("Name"), F.lit("File").alias("Type"), F.lit("Allocated").alias("Flags"),
        F.col("page_id").alias("Addr"), F.octet_length(html).cast("long").alias("Filesize"), F.lit("").alias("Created"), F.lit("").alias("Modified"), html.cast("binary").alias("content"),
    )


def dirent_of(names: DataFrame) -> DataFrame:
    """Directory entries from a prepared listing of names: path, name, short_name, type, flags, meta_addr, parent_addr, meta_seq, parent_seq.
    type and flags are codes; names that no metadata belongs to (null meta_addr) are left out."""
    text: list[Column] = [F.lit("").alias("Id"), *[up_to_nul(F.col(c)).alias(n) for c, n in (("path", "Path"), ("name", "Name"), ("short_name", "ShortName"))]]
    codes = [label_of(F.col("type"), NAME_TYPES).alias("Type"), flag_labels(F.col("flags"), NAME_FLAGS).alias("Flags")]
    numbers = [F.col(c).cast("long").alias(n) for c, n in (("meta_addr", "MetaAddr"), ("parent_addr", "ParentAddr"), ("meta_seq", "MetaSeq"), ("parent_seq", "ParentSeq"))]
    return names.where(F.col("meta_addr").isNotNull()).select(*text, *codes, *numbers)


def inode_of(metas: DataFrame) -> DataFrame:
    """Inodes from prepared metadata: addr, fs_offset, size, uid, gid, link, nlink, seq, type, flags, and seconds and nanos of created, accessed, modified and metadata."""
    times = [format_timestamp(F.col(f"{t}_s"), F.col(f"{t}_ns")).alias(n) for t, n in (("created", "Created"), ("accessed", "Accessed"), ("modified", "Modified"), ("metadata", "Metadata"))]
    numbers = {"addr": "Addr", "fs_offset": "FsOffset", "size": "Filesize", "uid": "Uid", "gid": "Gid"}
    return metas.select(
        F.lit("").alias("Id"), label_of(F.col("type"), NAME_TYPES).alias("Type"), flag_labels(F.col("flags"), META_FLAGS).alias("Flags"),
        *[F.col(a).cast("long").alias(b) for a, b in numbers.items()], up_to_nul(F.coalesce("link", F.lit(""))).alias("LinkTarget"),
        F.col("nlink").cast("long").alias("NumLinks"), F.col("seq").cast("long").alias("SeqNum"), *times,
    )
