"""The engine: load rules, scan files, write the tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.content import digest
from quarrymill.functions.identities import with_inode_id, with_record_id
from quarrymill.operators.hashsets import HashSet, in_hash_set
from quarrymill.operators.rules import answered_rules, rule_hits, rules_table
from quarrymill.operators.search import placed_hits, search_hits
from quarrymill.operators.signatures import Signature, identify, signature_faults
from quarrymill.plans.compiler import DEEPEST, with_answers
from quarrymill.plans.patterns import PatternError, byte_regex
from quarrymill.plans.ruletext import Pattern, Rule, RuleError, RuleSet, depth_of, read_rules
from quarrymill.sources.config import keyword_rule, rule_file, rule_folder
from quarrymill.sources.files import DIRENT, HASH, INODE, folders_below, full_table, open_source, qualified
from quarrymill.sources.staging import kept, remove

CODECS = ("none", "snappy", "gzip", "lz4", "zstd")


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rules: list[Rule] = []
        self.errors: list[RuleError | PatternError] = []
        self.signatures: list[Signature] = []
        self.known: list[HashSet] = []

    def load_rules(self, text: str) -> Engine:
        """Rules accumulate; bad ones are left out and reported in `errors`."""
        return self._add(read_rules(text))

    def load_rule_file(self, path: str) -> Engine:
        return self._add(rule_file(path))

    def load_rule_folder(self, path: str) -> Engine:
        return self._add(rule_folder(path))

    def load_keywords(self, *paths: str) -> Engine:
        return self._add(RuleSet([keyword_rule(list(paths))], []))

    def _add(self, found) -> Engine:
        self.errors += found.errors
        for rule in found.rules:
            wrong = [e for k, p in rule.patterns.items() if (e := self._fault(f"{rule.name}: {k}", p))]
            if max(depth_of(x) for x in (rule.metadata, rule.signature, rule.condition)) > DEEPEST:
                wrong.append(PatternError(f"{rule.name}: and and or alternate over {DEEPEST} levels deep"))
            self.errors += wrong
            self.rules += [rule] * (not wrong)
        return self

    def _fault(self, where: str, pattern: Pattern) -> PatternError | None:
        """Why a pattern cannot be searched, so that it is an error of its rule and not of every scan."""
        try:
            self.spark.sparkContext._jvm.java.util.regex.Pattern.compile(byte_regex(pattern))
        except (PatternError, Py4JJavaError) as error:
            reason = error if isinstance(error, PatternError) else error.java_exception.getMessage()
            return PatternError(f"{where}: {reason}")
        return None

    def with_signatures(self, signatures: list[Signature]) -> Engine:
        self.signatures = signatures
        self.errors += signature_faults(signatures)
        return self

    def without_known(self, digests: DataFrame, algorithm: str = "md5", column: str | None = None) -> Engine:
        """Leave out files whose digest is in a table of known digests, however many there are (lists of system files, say)."""
        self.known.append(HashSet(digests, algorithm, column))
        return self

    def scan(self, source: DataFrame | str, hashes: tuple[str, ...] = ("md5", "sha1", "sha256"), metadata_only: bool = False) -> Scan:
        files, folders = source, None
        if isinstance(source, str):
            files = open_source(self.spark, source)
            folders = folders_below(files, qualified(self.spark, source))
        for known in self.known:
            files = in_hash_set(files, known, known=False)
        if "sig_id" not in files.columns:
            files = identify(files, self.signatures)
        return Scan(self, files, hashes, metadata_only, folders)


class Scan:
    """Tables of one scan; each is computed when it is used. Tables have all columns of their schemas in sources.files."""

    def __init__(self, engine: Engine, files: DataFrame, hashes: tuple[str, ...], metadata_only: bool, folders: DataFrame | None = None):
        self.engine, self.files, self.hashes, self.metadata_only = engine, files, hashes, metadata_only
        self.entries = files if folders is None else files.unionByName(folders, allowMissingColumns=True)

    @property
    def dirent(self) -> DataFrame:
        """Files and folders. The parent's address is that of its path, if files do not tell it."""
        parent = {} if "ParentAddr" in self.entries.columns else {"ParentAddr": F.abs(F.xxhash64("Path"))}
        return with_record_id(full_table(self.entries, DIRENT, {"MetaAddr": F.col("Addr"), **parent}))

    @property
    def inode(self) -> DataFrame:
        """One row for each address of a file system; where files tell no file system, for each path, since hashed addresses of two paths may be equal."""
        links = {} if "NumLinks" in self.entries.columns else {"NumLinks": F.lit(1)}
        by = ["FsOffset", "Addr"] if "FsOffset" in self.entries.columns else ["Addr", "Path", "Name"]
        return with_inode_id(full_table(self.entries.dropDuplicates(by), INODE, links))

    @property
    def hash(self) -> DataFrame:
        """Digests of files; those that were not asked for are null."""
        given = {c: digest(c.lower(), "content") if c.lower() in self.hashes else F.lit(None) for c in HASH.names if c != "MetaAddr"}
        return full_table(self.files, HASH, {"MetaAddr": F.col("Addr"), **given})

    @property
    def rules(self) -> DataFrame:
        return rules_table(self.engine.spark, self.engine.rules)

    @property
    def rule_hits(self) -> DataFrame:
        return rule_hits(self.files, self.engine.rules, self.metadata_only)

    @property
    def search_hits(self) -> DataFrame:
        return hits_table(search_hits(self.files, self.engine.rules))

    def export(self, path: str, codec: str = "lz4") -> None:
        """One Parquet folder for each table. Contents are read once: digests, ids of rules and hits of each file are written first, and the tables are made from them."""
        if codec not in CODECS:
            raise ValueError(f"unknown codec {codec}")
        compression = "lz4_raw" if codec == "lz4" else codec
        rules = list({r.id: r for r in self.engine.rules}.values())
        digests = tuple(dict.fromkeys((*self.hashes, "sha256")))
        read = with_answers(self.files, rules, self.metadata_only, True, digests)
        at = f"{path}/_read"
        once = kept(read.select("Path", "Name", "Addr", *[F.col(f"_{a}").alias(a) for a in digests], "_ids", "_hits"), at)
        given = {c: F.col(c.lower()) if c.lower() in self.hashes else F.lit(None) for c in HASH.names if c != "MetaAddr"}
        tables = {
            "dirent": self.dirent,
            "inode": self.inode,
            "rules": self.rules,
            "hash": full_table(once, HASH, {"MetaAddr": F.col("Addr"), **given}),
            "rule_hits": answered_rules(once),
            "search_hits": hits_table(placed_hits(once.select(F.col("Addr").alias("file"), F.col("sha256").alias("file_hash"), F.col("_hits").alias("hits")), rules)),
        }
        for name, rows in tables.items():
            rows.write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")
        remove(self.engine.spark, at)


def hits_table(found: DataFrame) -> DataFrame:
    return found.select("pattern", "start_offset", "end_offset", "rule_id", "file_hash", "length", F.col("file").alias("addr"), "pattern_id")
