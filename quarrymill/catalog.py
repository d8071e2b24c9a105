"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.engine import Engine
from quarrymill.functions.blake3 import field_bytes
from quarrymill.functions.blake3_lanes import blake3_each
from quarrymill.functions.content import digest
from quarrymill.functions.labels import META_FLAGS, NAME_TYPES, VOLUME_SYSTEMS, file_system_id, flag_labels, format_timestamp, label_of, up_to_nul
from quarrymill.operators.hashsets import HashSet, in_hash_set
from quarrymill.operators.images import image_documents
from quarrymill.operators.rules import files_with_hits, hit_report, join_files, rule_hits, rules_table
from quarrymill.operators.search import hit_counts, search_hits
from quarrymill.operators.signatures import Check, Signature, identify
from quarrymill.operators.tables import exclude_known, first_inodes, full_paths, merge_ranges, run_layout, table_difference, unclaimed, unique_contents
from quarrymill.plans.ruletext import Rule, read_rules
from quarrymill.sources.config import yara_pattern
from quarrymill.sources.files import corpus_files, dirent_of, folders_of, inode_of, own_times, page_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FILES = """files AS (
  SELECT '/' || coalesce(source, '') || '/' || coalesce(lang, '') AS Path, doc_id || '.txt' AS Name, doc_id AS Addr,
         strlen(coalesce(text, '')) AS Filesize, coalesce(text, '') AS text,
         strftime(TIMESTAMP '2023-01-01 00:00:00' + to_seconds(doc_id * 3601), '%Y-%m-%d %H:%M:%S') AS Created,
         strftime(TIMESTAMP '2023-01-01 00:00:00' + to_seconds(doc_id * 7203), '%Y-%m-%d %H:%M:%S') AS Modified
  FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_files(table(spark, sf_dir, "documents"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rules_in(text: str) -> list[Rule]:
    found = read_rules(text)
    if found.errors:
        raise found.errors[0]
    return found.rules


# --- Rules over files: the rule, and what SQL says of a file. n(p): hits; sizes(p): their lengths; starts(p): their offsets.


def n(p: str) -> str:
    return f"len(regexp_extract_all(text, '(?s){p}'))"


def sizes(p: str) -> str:
    return f"list_transform(regexp_extract_all(text, '(?s){p}'), lambda x: strlen(x))"


def starts(p: str) -> str:
    both = f"'(?s)(.*?)({p})'"
    gaps, hits = f"regexp_extract_all(text, {both}, 1)", f"regexp_extract_all(text, {both}, 2)"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: strlen(array_to_string(list_slice({gaps}, 1, i), '')) + strlen(array_to_string(list_slice({hits}, 1, i - 1), '')))"


def start(p: str, nth: int) -> str:
    both = f"'(?s)(.*?)({p})'"
    gaps, hits = f"regexp_extract_all(text, {both}, 1)", f"regexp_extract_all(text, {both}, 2)"
    return f"CASE WHEN len({hits}) >= {nth} THEN strlen(array_to_string(list_slice({gaps}, 1, {nth}), '')) + strlen(array_to_string(list_slice({hits}, 1, {nth - 1}), '')) END"


def some(values: str, test: str) -> str:
    return f"len(list_filter({values}, lambda v: v {test})) > 0"


def grep(patterns: str, condition: str) -> str:
    return f"grep: patterns: {patterns} condition: {condition}"


A, B, C = 'a = "th[a-z]+"', 'b = "ing" fixed', 'c = "[0-9]+"'
RULES = {
    "meta_filesize": ("file_metadata: filesize > 5000", "Filesize > 5000"),
    "meta_filename": ('file_metadata: filename == "7.txt" or filename == "11.txt"', "Name IN ('7.txt', '11.txt')"),
    "meta_name_ne": ('file_metadata: filename != "7.txt"', "Name <> '7.txt'"),
    "meta_path": ('file_metadata: filepath == "/src3/en"', "Path = '/src3/en'"),
    "meta_created_range": (
        'file_metadata: created >= "2023-01-02 00:00:00" and created < "2023-01-09 12:00:00"',
        "Created >= '2023-01-02 00:00:00' AND Created < '2023-01-09 12:00:00'",
    ),
    "meta_compound": (
        'file_metadata: (filesize >= 2000 and modified <= "2023-01-20") or filepath == "/src0/de" and filesize != 100',
        "(Filesize >= 2000 AND Modified <= '2023-01-20') OR (Path = '/src0/de' AND Filesize <> 100)",
    ),
    "cond_any": (grep(f"{C} d = \"MIT License\" fixed", "any()"), f"{n('[0-9]+')} > 0 OR {n('MIT License')} > 0"),
    "cond_any_listed": (grep(f"{A} {B} {C}", "any(c)"), f"{n('[0-9]+')} > 0"),
    "cond_all": (grep(f"{A} {B} {C}", "all()"), f"{n('th[a-z]+')} > 0 AND {n('ing')} > 0 AND {n('[0-9]+')} > 0"),
    "cond_all_listed": (grep(f"{A} {B} {C}", "all(a, b)"), f"{n('th[a-z]+')} > 0 AND {n('ing')} > 0"),
    "cond_count": (grep(A, "count(a) > 40"), f"{n('th[a-z]+')} > 40"),
    "cond_count_zero": (grep(f"{A} {B}", "count(b) == 0"), f"{n('ing')} = 0"),
    "cond_length_any": (grep(A, "length(a) >= 15"), some(sizes("th[a-z]+"), ">= 15")),
    "cond_length_nth": (grep(A, "length(a, 3) == 5"), f"coalesce(({sizes('th[a-z]+')})[3] = 5, false)"),
    "cond_offset_any": (grep(C, "offset(c) < 400"), some(starts("[0-9]+"), "< 400")),
    "cond_offset_nth": (grep(A, "offset(a, 2) > 60"), f"coalesce({start('th[a-z]+', 2)} > 60, false)"),
    "cond_has_hits": (
        grep(f"{A} {B} {C}", "count_has_hits() == 2"),
        f"({n('th[a-z]+')} > 0)::INT + ({n('ing')} > 0)::INT + ({n('[0-9]+')} > 0)::INT = 2",
    ),
    "cond_boolean_mix": (
        grep(f"{A} {B} {C}", "(count(a) > 20 or offset(c) <= 100) and count_has_hits(b, c) >= 1"),
        f"({n('th[a-z]+')} > 20 OR {some(starts('[0-9]+'), '<= 100')}) AND ({n('ing')} > 0)::INT + ({n('[0-9]+')} > 0)::INT >= 1",
    ),
    "cond_nocase": (grep('a = "THE" fixed nocase b = "[x-z]Q" nocase', "count(a) > 30 or any(b)"), f"{n('(?i:the)')} > 30 OR {n('(?i:[x-z]q)')} > 0"),
    "cond_hex": (grep("a = { 74 68 65 20 }", "count(a) >= 10"), f"{n('the ')} >= 10"),
    "rule_meta_grep": (f"file_metadata: filesize > 1000 {grep(A, 'count(a) > 10')}", f"Filesize > 1000 AND {n('th[a-z]+')} > 10"),
    "rule_without_body": ("", "true"),
}


def _add_rule(name: str, body: str, test: str) -> None:
    rules = rules_in(f"rule {name} {{ {body} }}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule_hits(files_of(spark, sf_dir), rules)

    run.__name__ = name
    query(f"WITH {FILES} SELECT DISTINCT '{rules[0].id}' AS id, Path AS path, Name AS name, Addr AS addr FROM files WHERE {test}")(run)


for _name, (_body, _test) in RULES.items():
    _add_rule(_name, _body, _test)

MANY = ("meta_filesize", "meta_path", "cond_count", "cond_offset_nth", "cond_has_hits", "rule_meta_grep")
MANY_RULES = [r for k in MANY for r in rules_in(f"rule {k} {{ {RULES[k][0]} }}")]


@query(f"WITH {FILES} " + " UNION ".join(f"SELECT '{r.id}' AS id, Path AS path, Name AS name, Addr AS addr FROM files WHERE {RULES[k][1]}" for k, r in zip(MANY, MANY_RULES)))
def rule_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rules in one pass over the files."""
    return rule_hits(files_of(spark, sf_dir), MANY_RULES)


@query(f"WITH {FILES} SELECT DISTINCT '{MANY_RULES[-1].id}' AS id, Path AS path, Name AS name, Addr AS addr FROM files WHERE Filesize > 1000")
def rule_metadata_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(files_of(spark, sf_dir), [MANY_RULES[-1]], metadata_only=True)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{r.name}')" for r in MANY_RULES) + ") AS t(id, name)")
def rules_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_table(spark, MANY_RULES)


# --- Hashes


@query("SELECT doc_id AS addr, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark, sf_dir).select(F.col("Addr").alias("addr"), *[digest(a, "content").alias(a) for a in ("md5", "sha1", "sha256")])


_PICK = "SELECT md5(coalesce(text, '')) AS m, sha256(coalesce(text, '')) AS s FROM documents WHERE doc_id IN (0, 3)"


@query(f"WITH {FILES} SELECT DISTINCT Path AS path, Name AS name, Addr AS addr FROM files JOIN ({_PICK}) k ON md5(text) = k.m AND sha256(text) = k.s")
def hash_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of two digests, or another such record; the digests are those of two documents."""
    files = files_of(spark, sf_dir)
    known = files.where(F.col("Addr").isin(0, 3)).select(digest("md5", "content").alias("m"), digest("sha256", "content").alias("s")).collect()
    records = "\n".join(f'md5 == "{r["m"].upper()}", sha256 == "{r["s"]}"' for r in known)
    return rule_hits(files, rules_in(f"rule known {{ hash: {records} }}")).drop("id")


@query("SELECT doc_id AS addr FROM documents WHERE md5(coalesce(text, '')) NOT IN (SELECT md5(coalesce(text, '')) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def hash_exclusion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir).select("Addr", digest("md5", "content").alias("md5"))
    known = files.groupBy("md5").count().where("count > 1")
    return exclude_known(files, known).select(F.col("Addr").alias("addr"))


LISTED = """SELECT md5(concat_ws('/', l_orderkey, l_linenumber, part)) AS m FROM lineitem, (VALUES (0), (1)) p(part)
UNION ALL SELECT upper(md5(coalesce(text, ''))) FROM documents WHERE doc_id % 3 = 0"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of known digests: two for each line item and those of every third document, some in upper case."""
    lines = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*[F.md5(F.concat_ws("/", "l_orderkey", "l_linenumber", F.lit(i))) for i in (0, 1)])).alias("md5"))
    texts = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.upper(F.md5(F.coalesce("text", F.lit("")))))
    return lines.union(texts)


@query(f"SELECT doc_id AS addr, md5(coalesce(text, '')) AS md5 FROM documents WHERE md5(coalesce(text, '')) IN (SELECT lower(m) FROM ({LISTED}))")
def hash_set_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose digest is in a list of digests that grows with the tables (1.2 million at sf0.1)."""
    return in_hash_set(files_of(spark, sf_dir), HashSet(_listed(spark, sf_dir), "md5", small=1_000)).select(F.col("Addr").alias("addr"), digest("md5", "content").alias("md5"))


@query(f"SELECT doc_id AS addr FROM documents WHERE md5(coalesce(text, '')) NOT IN (SELECT lower(m) FROM ({LISTED}))")
def hash_set_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_hash_set(files_of(spark, sf_dir), HashSet(_listed(spark, sf_dir), "md5", small=1_000), known=False).select(F.col("Addr").alias("addr"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first_addr, count(*) AS files FROM documents GROUP BY 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_contents(files_of(spark, sf_dir))


@query()
def blake3_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of directory entries."""
    rows = files_of(spark, sf_dir).select("Path", "Name", "Type", "Flags", F.col("Addr").alias("MetaAddr"))

    def name(batches):
        for b in batches:
            yield b.assign(Id=blake3_each([field_bytes(p, x, "", t, f, int(a), 0, 0, 0) for p, x, t, f, a in zip(b["Path"], b["Name"], b["Type"], b["Flags"], b["MetaAddr"])]))

    return rows.mapInPandas(name, "Path string, Name string, Type string, Flags string, MetaAddr long, Id string")


@query()
def fuzzy_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(table(spark, sf_dir, "pages")).select(F.col("Addr").alias("addr"), digest("ssdeep", "content").alias("ssdeep"))


@query()
def blake3_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark, sf_dir).select(F.col("Addr").alias("addr"), digest("blake3", "content").alias("blake3"))


# --- Search hits


def hits_sql(rule: Rule, spelled: dict[str, str], source: str = "text") -> str:
    parts = []
    for k, regex in spelled.items():
        both = f"'(?s)(.*?)({regex})'"
        parts.append(
            f"SELECT Addr AS file, '{k}' AS pattern_id, unnest(regexp_extract_all({source}, {both}, 1)) AS g, unnest(regexp_extract_all({source}, {both}, 2)) AS m,"
            f" unnest(range(1, len(regexp_extract_all({source}, {both}, 2)) + 1)) AS nth FROM files"
        )
    ends = "sum(strlen(g) + strlen(m)) OVER (PARTITION BY file, pattern_id ORDER BY nth)"
    return f"""WITH {FILES}, h AS ({' UNION ALL '.join(parts)})
    SELECT file, '{rule.id}' AS rule_id, pattern_id, nth, ({ends} - strlen(m))::BIGINT AS start_offset, ({ends})::BIGINT AS end_offset, strlen(m) AS length FROM h"""


HIT_COLUMNS = ("file", "rule_id", "pattern_id", "cast(nth AS bigint) AS nth", "start_offset", "end_offset", "length")
HITS = {
    "hits_fixed": ('a = "the" fixed', {"a": "the"}),
    "hits_regex": ('a = "th[a-z]+"', {"a": "th[a-z]+"}),
    "hits_nocase": ('a = "tion" fixed nocase', {"a": "(?i:tion)"}),
    "hits_hex": ("a = { 69 6e 67 }", {"a": "ing"}),
    "hits_numbers": (r'a = "\d{3,8}"', {"a": "[0-9]{3,8}"}),
    "hits_multi_pattern": ('a = "er[a-z]*" b = "on" fixed c = "[0-9]+"', {"a": "er[a-z]*", "b": "on", "c": "[0-9]+"}),
    "hits_unicode": (
        'u = "[a-z]*[à-ïñ-ö]{1,2}[a-zß-ÿ]*" nocase encodings=UTF-8 v = "[^a-zà-ÿ.,]{2}[é-ë]"',
        {"u": "[a-zA-Z]*[à-ïñ-öÀ-ÏÑ-ÖÅ]{1,2}[a-zA-ZſKẞß-ÿÀ-ÖØ-ÞŸ÷]*", "v": "[^a-zà-ÿ.,]{2}[é-ë]"},
    ),
}


def _add_hits(name: str, patterns: str, spelled: dict[str, str]) -> None:
    rules = rules_in(f"rule {name} {{ {grep(patterns, 'any()')} }}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search_hits(files_of(spark, sf_dir), rules).selectExpr(*HIT_COLUMNS)

    run.__name__ = name
    query(hits_sql(rules[0], spelled))(run)


for _name, (_patterns, _spelled) in HITS.items():
    _add_hits(_name, _patterns, _spelled)

UTF16 = rules_in(f"rule utf16 {{ {grep('a = \"license\" nocase encodings=UTF-16LE,UTF-8 b = \"[A-Z][a-z]{9}\" encodings=UTF-16LE', 'any()')} }}")


def _wide(k: str, regex: str) -> str:
    both = f"'(?s)(.*?)({regex})'"
    return f"""SELECT Addr, '{k}' AS pattern_id, unnest(regexp_extract_all(text, {both}, 1)) AS g, unnest(regexp_extract_all(text, {both}, 2)) AS m,
    unnest(range(1, len(regexp_extract_all(text, {both}, 2)) + 1)) AS nth FROM files"""


@query(f"""WITH {FILES}, u AS ({_wide('a', '(?i:license)')} UNION ALL {_wide('b', '[A-Z][a-z]{9}')})
SELECT Addr AS file, pattern_id, nth, (2 * (sum(length(g) + length(m)) OVER (PARTITION BY Addr, pattern_id ORDER BY nth) - length(m)))::BIGINT AS start_offset, (2 * length(m))::INT AS length FROM u""")
def hits_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-16LE; offsets are bytes of that. One pattern is searched in two encodings."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("Addr"), F.encode(F.coalesce("text", F.lit("")), "UTF-16LE").alias("content"))
    return search_hits(files, UTF16).select("file", "pattern_id", F.col("nth").cast("long").alias("nth"), "start_offset", F.col("length").cast("int").alias("length"))


HAVING = rules_in(f"rule having {{ {grep(A, 'any()')} }}")


@query(f"""WITH h AS ({hits_sql(HAVING[0], {'a': 'th[a-z]+'})}) SELECT file, rule_id, pattern_id, count(*) AS hits, max(length) AS longest, min(start_offset) AS first_offset
FROM h GROUP BY ALL HAVING count(*) >= 25""")
def hits_groupby_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_counts(search_hits(files_of(spark, sf_dir), HAVING), 25)


#: A thousand words of three syllables, each a rule and a pattern.
_SYLLABLES = ("th", "er", "on", "an", "re", "in", "ed", "eau", "ent", "ion")
MANY_WORDS = [a + b + c for a in _SYLLABLES for b in _SYLLABLES for c in _SYLLABLES]
WORD_RULES = rules_in("\n".join(f'rule w{i} {{ grep: patterns: {w} = "{w}" fixed condition: any() }}' for i, w in enumerate(MANY_WORDS)))
_WORDS = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{w}')" for r, w in zip(WORD_RULES, MANY_WORDS)) + ") AS t(id, word))"


@query(f"WITH {FILES}, {_WORDS} SELECT id, Path AS path, Name AS name, Addr AS addr FROM files JOIN w ON contains(text, word)")
def rules_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rules in one pass over the files."""
    return rule_hits(files_of(spark, sf_dir), WORD_RULES)


@query(f"""WITH {FILES}, {_WORDS} SELECT Addr AS file, id AS rule_id, word AS pattern_id, len(string_split(text, word)) - 1 AS hits, strlen(word) AS longest, strlen(split_part(text, word, 1)) AS first_offset
FROM files JOIN w ON contains(text, word)""")
def hits_thousand_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a thousand patterns, counted."""
    return hit_counts(search_hits(files_of(spark, sf_dir), WORD_RULES))


YARA = Rule("yara", patterns={"a": yara_pattern("the", ("fullword",)), "b": yara_pattern("{ 74 69 6f 6e }")}, id="yara")


@query(hits_sql(YARA, {"a": "[^0-9A-Za-z_]the[^0-9A-Za-z_]", "b": "tion"}))
def hits_yara_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_hits(files_of(spark, sf_dir), [YARA]).selectExpr(*HIT_COLUMNS)


# --- Exported tables


@query(f"""WITH {FILES} SELECT Path, Name, '' AS ShortName, 'File' AS Type, 'Allocated' AS Flags, Addr AS MetaAddr, 0::BIGINT AS MetaSeq, 0::BIGINT AS ParentSeq FROM files""")
def export_dirent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the columns that are hashes SQL does not have."""
    return Engine(spark).scan(files_of(spark, sf_dir)).dirent.drop("Id", "ParentAddr")


@query(f"""WITH {FILES} SELECT 'File' AS Type, 'Allocated' AS Flags, Addr, 0::BIGINT AS FsOffset, Filesize, 0::BIGINT AS Uid, 0::BIGINT AS Gid, '' AS LinkTarget, 1::BIGINT AS NumLinks,
0::BIGINT AS SeqNum, Created, '' AS Accessed, Modified, '' AS Metadata FROM files""")
def export_inode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).scan(files_of(spark, sf_dir)).inode.drop("Id")


@query(f"WITH {FILES} SELECT Addr AS MetaAddr, md5(text) AS MD5, sha1(text) AS SHA1, sha256(text) AS SHA256 FROM files")
def export_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).scan(files_of(spark, sf_dir)).hash.drop("Blake3", "Ssdeep")


REPORT = rules_in(f"rule report {{ {grep('a = \"tion\" fixed', 'any()')} }}")


@query(f"""WITH {FILES} SELECT Path, Name, Addr, Filesize, sha256(text) AS SHA256, '{REPORT[0].id}' AS rule_id, 'a' AS pattern_id, {n('tion')}::BIGINT AS hits,
strlen(split_part(text, 'tion', 1)) AS first_offset FROM files WHERE {n('tion')} > 0""")
def hits_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, metadata, digests and hits joined; each content is searched once."""
    scan = Engine(spark).scan(files_of(spark, sf_dir))
    return hit_report(scan.dirent, scan.inode, scan.hash, search_hits(scan.files, REPORT, key=None))


@query(f"WITH {FILES} SELECT Path, Name, Addr AS MetaAddr FROM files WHERE {n('tion')} > 0")
def hits_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = Engine(spark).scan(files_of(spark, sf_dir))
    return files_with_hits(scan.dirent, scan.hash, search_hits(scan.files, REPORT, key=None)).select("Path", "Name", "MetaAddr")


def _shown(kind: str, seconds: str) -> str:
    return f"CASE WHEN fs = '{kind}' AND {seconds} > 0 THEN strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds({seconds}), '%Y-%m-%d %H:%M:%S') END"


@query(f"""WITH c AS (SELECT c_custkey AS k, ['NTFS', 'EXT', 'HFS', 'FAT'][(c_custkey % 4 + 1)::INT] AS fs FROM customer)
SELECT k AS addr, {_shown('NTFS', 'k * 1009')} AS created, {_shown('EXT', '(k % 8) * 2003')} AS deleted, {_shown('HFS', 'k * 3001')} AS backup FROM c""")
def times_by_file_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    seconds = {"fn_created": k * 1_009, "fn_accessed": k, "fn_modified": k, "fn_metadata": k, "deleted": (k % 8) * 2_003, "backup": k * 3_001}
    metas = table(spark, sf_dir, "customer").select(k.alias("addr"), F.get(F.array(*map(F.lit, ("NTFS", "EXT", "HFS", "FAT"))), (k % 4).cast("int")).alias("fs_type"), *[v.alias(f"{t}_s") for t, v in seconds.items()], *[F.lit(0).alias(f"{t}_ns") for t in seconds])
    return own_times(metas).select("addr", F.col("FnCreated").alias("created"), F.col("Deleted").alias("deleted"), F.col("Backup").alias("backup"))


# --- Signatures


HTML = Signature("html", "HTML", pattern="<!DOCTYPE html>", nocase=True, checks=(Check("=/c", 0, True, b"<!doctype html>"),), extensions=("HTML", "HTM"))
SIGNATURES = [
    Signature("long", "HTML with a language", pattern=r'<!DOCTYPE html><html lang="fr"', extensions=("HTML",)),
    HTML,
    Signature("end", "ends with a tag", checks=(Check("=", -1, False, b">"),)),
]


@query("""SELECT page_id AS addr, CASE WHEN html LIKE '<!DOCTYPE html><html lang="fr"%' THEN 'long' WHEN lower(left(html, 15)) = '<!doctype html>' THEN 'html'
WHEN right(html, 1) = '>' THEN 'end' END AS sig_id FROM pages""")
def sig_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(page_files(table(spark, sf_dir, "pages")), SIGNATURES).select(F.col("Addr").alias("addr"), "sig_id")


CHECKS = [
    Signature("masked", checks=(Check("=", 0, True, b"TH", b"\xdf"),)),
    Signature("above", checks=(Check(">", 0, True, b"S"), Check("<", 1, True, b"e"))),
    Signature("tail", checks=(Check("!", -1, False, b"."),)),
    Signature("high", checks=(Check("=", 0, True, b"\xc3"),)),
]


@query("""SELECT doc_id AS addr, CASE WHEN text = '' THEN NULL WHEN lower(left(text, 2)) = 'th' THEN 'masked'
WHEN ord(text) BETWEEN 84 AND 127 AND ord(substr(text, 2, 1)) < 101 AND length(text) > 1 THEN 'above'
WHEN right(text, 1) <> '.' THEN 'tail' WHEN ord(text) BETWEEN 192 AND 255 THEN 'high' END AS sig_id
FROM documents""")
def sig_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(files_of(spark, sf_dir), CHECKS).select(F.col("Addr").alias("addr"), "sig_id")


#: Over 900 signatures: every capital with a small letter, longer ones that outrank some of these, ends of files by extension or not, and bytes within the head.
LONGER = ("The", "And", "Thi", "Thh", "Les", "Des", "Een", "Het", "Las", "Los", "Der", "Die", "Das", "Und", "Una", "Une")
LETTERS = [chr(c) for c in range(97, 123)]
MANY_SIGNATURES = [
    *[Signature(f"pair {a.upper()}{b}", pattern=a.upper() + b) for a in LETTERS for b in LETTERS], *[Signature(f"long {x}", pattern=rf"{x[0]}\x{ord(x[1]):02x}{x[2]}", fixed=False) for x in LONGER],
    *[Signature(f"third {a}", checks=(Check("=", 2, True, a.encode()),)) for a in LETTERS[::2]],
    *[Signature(f"end {a}{b}", checks=(Check("=/c", -2, False, (a + b).encode()), Check("!", 0, True, b" ")), extensions=("TXT",) * (a + b == "a.")) for b in ".,!?:;|" for a in LETTERS],
]


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS (SELECT *, encode(text) AS b FROM t) SELECT doc_id AS addr,
CASE WHEN left(text, 3) IN (""" + ", ".join(f"'{x}'" for x in LONGER) + """) THEN 'long ' || left(text, 3) WHEN regexp_matches(text, '^[A-Z][a-z]') THEN 'pair ' || left(text, 2)
WHEN regexp_matches(text, '[aA][.]$') AND left(text, 1) <> ' ' THEN 'end a.' WHEN regexp_matches(substr(hex(b), 5, 2), '^(6[13579BDF]|7[13579])$') THEN 'third ' || chr(('0x' || substr(hex(b), 5, 2))::INT)
WHEN regexp_matches(text, '[A-Za-z][.,!?:;|]$') AND left(text, 1) <> ' ' THEN 'end ' || lower(right(text, 2)) END AS sig_id,
CASE WHEN regexp_matches(text, '^[A-Z][a-z]') THEN 1 WHEN regexp_matches(text, '[aA][.]$') AND left(text, 1) <> ' ' THEN 2
WHEN regexp_matches(substr(hex(b), 5, 2), '^(6[13579BDF]|7[13579])$') OR regexp_matches(text, '[A-Za-z][.,!?:;|]$') AND left(text, 1) <> ' ' THEN 3 END AS sig_stage FROM h""")
def sig_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over 900 signatures in one pass."""
    return identify(files_of(spark, sf_dir), MANY_SIGNATURES).select(F.col("Addr").alias("addr"), "sig_id", "sig_stage")


@query("""SELECT sig_id, sig_stage, count(*) AS files FROM (SELECT CASE WHEN html LIKE '<!DOCTYPE html><html lang="fr"%' THEN 'long' WHEN lower(left(html, 15)) = '<!doctype html>' THEN 'html'
WHEN right(html, 1) = '>' THEN 'end' END AS sig_id, CASE WHEN lower(left(html, 15)) = '<!doctype html>' THEN 1 WHEN right(html, 1) = '>' THEN 3 END AS sig_stage FROM pages) GROUP BY ALL""")
def sig_rank_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(page_files(table(spark, sf_dir, "pages")), SIGNATURES).groupBy("sig_id", "sig_stage").agg(F.count("*").alias("files"))


FULL = rules_in(f"""rule full {{ meta: author = "x" file_metadata: filesize > 3000 signature: name == "HTML" or id == "long" {grep('s = "<script" fixed p = "<p[ >]"', 'any(s) or count(p) > 5')} }}""")


@query(f"""SELECT '{FULL[0].id}' AS id, '/pages' AS path, page_id || '.html' AS name, page_id AS addr FROM pages
WHERE strlen(html) > 3000 AND lower(left(html, 15)) = '<!doctype html>' AND (contains(html, '<script') OR len(regexp_extract_all(html, '<p[ >]')) > 5)""")
def rule_full_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(identify(page_files(table(spark, sf_dir, "pages")), SIGNATURES), FULL)


# --- Names, metadata and blocks


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as names, customers as their folders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lit("/orders").alias("path"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit("\0x")).alias("name"), F.lit("").alias("short_name"),
        (F.col("o_orderkey") % 12).cast("int").alias("type"), (F.col("o_orderkey") % 4).cast("int").alias("flags"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("meta_addr"), F.lit(1).alias("parent_addr"), F.lit(0).alias("meta_seq"), F.lit(0).alias("parent_seq"),
    )


def _metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    time = {f"{t}_{u}": (F.col("c_custkey") * k).cast("long") for i, t in enumerate(("created", "accessed", "modified", "metadata")) for u, k in (("s", 1_000_003 * (i + 1)), ("ns", 77_700 * i))}
    return c.select(
        F.col("c_custkey").alias("addr"), F.lit(32_768).alias("fs_offset"), F.floor(F.abs("c_acctbal")).alias("size"), F.col("c_nationkey").alias("uid"), F.lit(0).alias("gid"),
        F.lit(None).cast("string").alias("link"), F.lit(1).alias("nlink"), F.lit(0).alias("seq"), F.lit(5).alias("type"), (F.col("c_custkey") % 64).cast("int").alias("flags"),
        *[v.alias(k) for k, v in time.items()],
    )


def _case(code: str, labels: dict[int, str]) -> str:
    return "CASE " + " ".join(f"WHEN {code} = {k} THEN '{v}'" for k, v in labels.items()) + " ELSE '' END"


def _flags(bits: str, labels: dict[int, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({bits} & {k}) <> 0 THEN '{v}' END" for k, v in labels.items()) + "], lambda x: x IS NOT NULL), ', ')"


@query(f"""SELECT 'o' || o_orderkey AS name, {_case('o_orderkey % 12', NAME_TYPES)} AS type, c_custkey AS addr, floor(abs(c_acctbal))::BIGINT AS filesize
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0""")
def dirent_inode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_files(dirent_of(_names(spark, sf_dir)), inode_of(_metas(spark, sf_dir)))
    return joined.select(F.col("Name").alias("name"), F.col("Type").alias("type"), F.col("Addr").alias("addr"), F.col("Filesize").alias("filesize"))


@query("SELECT count(*) AS inodes FROM (SELECT DISTINCT o_custkey FROM orders)")
def inode_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.lit(0).alias("FsOffset"), F.col("o_custkey").alias("Addr"))
    return first_inodes(seen).agg(F.count("*").alias("inodes"))


@query(f"SELECT o_orderkey AS addr, {_flags('(o_orderkey % 64)', META_FLAGS)} AS flags, {_case('o_orderkey % 17', VOLUME_SYSTEMS)} AS kind FROM orders")
def flags_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("addr"), flag_labels(F.col("o_orderkey") % 64, META_FLAGS).alias("flags"), label_of(F.col("o_orderkey") % 17, VOLUME_SYSTEMS).alias("kind"))


@query("""WITH e AS (SELECT event_id, event_id * 86399 AS s, (event_id * 1234500) % 1000000000 AS ns FROM events)
SELECT event_id, CASE WHEN s = 0 AND ns = 0 THEN '' ELSE strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(s), '%Y-%m-%d %H:%M:%S') ||
CASE WHEN ns > 0 THEN '.' || rtrim(lpad(ns::VARCHAR, 9, '0'), '0') ELSE '' END END AS shown FROM e""")
def timestamp_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", format_timestamp(F.col("event_id") * 86_399, (F.col("event_id") * 1_234_500) % 1_000_000_000).alias("shown"))


@query("SELECT event_id, split_part(event_type, 'r', 1) AS cut, lower(hex(event_type)) AS id FROM events")
def text_cut_and_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    turned = file_system_id(F.reverse(F.col("event_type")).cast("binary"), F.lit(True))
    return e.select("event_id", up_to_nul(F.replace("event_type", F.lit("r"), F.lit("\0"))).alias("cut"), turned.alias("id"))


@query("""SELECT c_custkey AS addr, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT -1 - n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -1000 - r_regionkey, r_name FROM region""")
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths from parent addresses: regions, nations and customers as a tree."""
    c, n_, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.select(F.col("c_custkey").alias("MetaAddr"), (-1 - F.col("c_nationkey")).cast("long").alias("ParentAddr"), F.col("c_name").alias("Name"))
    rows = rows.union(n_.select((-1 - F.col("n_nationkey")).cast("long"), (-1000 - F.col("n_regionkey")).cast("long"), "n_name"))
    rows = rows.union(r.select((-1000 - F.col("r_regionkey")).cast("long"), F.lit(None).cast("long"), "r_name"))
    return full_paths(rows).select(F.col("MetaAddr").alias("addr"), F.col("FullPath").alias("path"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 2 AS fs FROM orders),
d AS (SELECT DISTINCT fs, o_custkey FROM o), l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 2 AS fs FROM lineitem)
SELECT fs, (1000000000 + o_custkey)::BIGINT AS addr, 'top/c' || o_custkey AS path FROM d
UNION ALL SELECT fs, o_orderkey + 10, 'top/c' || o_custkey || '/o' || o_orderkey FROM o
UNION ALL SELECT fs, NULL, 'lost' || l_orderkey || '-' || l_linenumber FROM l WHERE l_linenumber = 7
UNION ALL SELECT o.fs, 2000000000 + o_orderkey // 4, 'top/c' || o_custkey || '/o' || o_orderkey || '/same' FROM o
UNION ALL SELECT fs, 1, 'top' FROM (VALUES (0), (1)) AS t(fs)""")
def path_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths where files have several names in several folders (orders share files), addresses repeat in two file systems, and some names have no parent."""
    o, l_ = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    fs, folder = (F.col("o_orderkey") % 2).alias("fs"), (F.col("o_custkey") + 1_000_000_000).cast("long")
    row = lambda df, f, a, up, name: df.select(f, a.cast("long").alias("MetaAddr"), up.cast("long").alias("ParentAddr"), name.alias("Name"))
    text = lambda c: F.col(c).cast("string")
    rows = row(o, fs, folder, F.lit(1), F.concat(F.lit("c"), text("o_custkey"))).distinct()
    rows = rows.union(row(o, fs, F.col("o_orderkey") + 10, folder, F.concat(F.lit("o"), text("o_orderkey"))))
    rows = rows.union(row(o, fs, F.floor(F.col("o_orderkey") / 4) + 2_000_000_000, F.col("o_orderkey") + 10, F.lit("same")))
    lost = l_.where("l_linenumber = 7")
    rows = rows.union(row(lost, (F.col("l_orderkey") % 2).alias("fs"), F.lit(None), F.lit(None), F.concat(F.lit("lost"), text("l_orderkey"), F.lit("-"), text("l_linenumber"))))
    rows = rows.union(row(spark.range(2), F.col("id").alias("fs"), F.lit(1), F.lit(1), F.lit("top")))
    return full_paths(rows, file_system="fs").select("fs", F.col("MetaAddr").alias("addr"), F.col("FullPath").alias("path"))


@query(f"WITH {FILES}, p AS (SELECT DISTINCT string_split(Path, '/') AS x FROM files) SELECT DISTINCT '/' || x[2] AS path, x[3] AS name FROM p WHERE x[3] <> '' UNION SELECT DISTINCT '', x[2] FROM p")
def folder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders_of(files_of(spark, sf_dir)).select(F.col("Path").alias("path"), F.col("Name").alias("name"))


@query("""SELECT doc_id AS id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION
SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def table_diff_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_difference(*[table(spark, sf_dir, t).select(F.col("doc_id").alias("id")) for t in ("documents", "labels")])


CLAIMED = "SELECT l_linenumber AS fs, l_orderkey AS inum, l_partkey * 9 AS b, l_partkey * 9 + l_quantity::BIGINT AS e FROM lineitem"
ALLOCATED = "SELECT (o_orderkey % 7 + 1)::INT AS fs, o_custkey * 9 AS b, o_custkey * 9 + 1 + o_orderkey % 6 AS e FROM orders"


@query(f"""WITH c AS (SELECT DISTINCT fs, inum, unnest(range(b, e)) AS x FROM ({CLAIMED})), a AS (SELECT DISTINCT fs, unnest(range(b, e)) AS x FROM ({ALLOCATED})),
f AS (SELECT fs, inum, x, x - row_number() OVER (PARTITION BY fs, inum ORDER BY x) AS g FROM c ANTI JOIN a USING (fs, x))
SELECT fs, inum, min(x) AS begin, max(x) + 1 AS "end" FROM f GROUP BY fs, inum, g""")
def block_claims_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of deleted files that no live file has."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    claimed = li.select(F.col("l_linenumber").alias("fs"), F.col("l_orderkey").alias("inum"), (F.col("l_partkey") * 9).alias("begin"), (F.col("l_partkey") * 9 + F.col("l_quantity").cast("long")).alias("end"))
    live = o.select((F.col("o_orderkey") % 7 + 1).cast("int").alias("fs"), (F.col("o_custkey") * 9).alias("begin"), (F.col("o_custkey") * 9 + 1 + F.col("o_orderkey") % 6).alias("end"))
    return unclaimed(claimed, live, ["fs"]).select("fs", "inum", "begin", "end")


@query(f"""WITH a AS (SELECT DISTINCT fs, unnest(range(b, e)) AS x FROM ({ALLOCATED})), g AS (SELECT fs, x, x - row_number() OVER (PARTITION BY fs ORDER BY x) AS i FROM a)
SELECT fs, min(x) AS begin, max(x) + 1 AS "end" FROM g GROUP BY fs, i""")
def block_ranges_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    live = o.select((F.col("o_orderkey") % 7 + 1).cast("int").alias("fs"), (F.col("o_custkey") * 9).alias("begin"), (F.col("o_custkey") * 9 + 1 + F.col("o_orderkey") % 6).alias("end"))
    return merge_ranges(live, ["fs"])


@query("""WITH p AS (SELECT o_orderkey AS image, 0 AS nth, 'image' AS kind, min(o_orderpriority) AS detail FROM orders GROUP BY 1
UNION ALL SELECT o_orderkey, 1, CASE WHEN min(o_orderstatus) = 'P' THEN 'file_system' ELSE 'volume_system' END, min(o_orderstatus) FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1
UNION ALL SELECT l_orderkey, 2 * l_linenumber, 'volume', min(l_linestatus) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0) GROUP BY 1, 2
UNION ALL SELECT l_orderkey, 2 * l_linenumber + 1, 'file_system', min(l_returnflag) FROM lineitem WHERE l_returnflag <> 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1, 2),
w AS (SELECT *, lag(kind) OVER o AS before, CASE WHEN lead(kind) OVER o = 'file_system' THEN ':' || lead(detail) OVER o ELSE '' END AS within FROM p WINDOW o AS (PARTITION BY image ORDER BY nth)),
f AS (SELECT *, kind = 'image' OR kind = 'volume_system' OR (kind = 'file_system' AND before <> 'file_system') OR (kind = 'volume' AND before IN ('volume_system', 'volume', 'file_system')
  AND count(*) FILTER (kind = 'volume_system') OVER (PARTITION BY image) > 0) AS fits FROM w),
g AS (SELECT image, arg_min(kind || ' after ' || before, nth) FILTER (NOT fits) AS fault, min(detail) FILTER (kind = 'image') AS described, min(detail) FILTER (kind = 'volume_system') AS system,
  min(detail) FILTER (kind = 'file_system' AND before = 'image') AS files, string_agg(detail || within, ',' ORDER BY nth) FILTER (kind = 'volume') AS volumes FROM f GROUP BY image)
SELECT image, fault, CASE WHEN fault IS NULL THEN described END AS described, CASE WHEN fault IS NULL THEN system END AS system, CASE WHEN fault IS NULL THEN files END AS files,
CASE WHEN fault IS NULL AND system IS NOT NULL THEN coalesce(volumes, '') END AS volumes FROM g""")
def image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images, their line items as volumes of which some hold a file system; some orders have their file system in the image, some have parts where none may be."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("image")).agg(F.min("o_orderpriority").alias("described"), F.min("o_orderstatus").alias("status"))
    second = F.when(F.col("status") == "P", "file_system").otherwise("volume_system")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), "l_linenumber", "l_linestatus", "l_returnflag").join(orders, "image").where("status <> 'P' OR image % 2 = 0")
    kept = items.where("l_returnflag <> 'N' AND status <> 'P'")
    parts = [
        orders.select("image", F.lit(0).alias("nth"), F.lit("image").alias("kind"), F.col("described").alias("detail")),
        orders.where("image % 11 <> 0").select("image", F.lit(1), second, "status"),
        items.groupBy("image", F.expr("2 * l_linenumber")).agg(F.lit("volume"), F.min("l_linestatus")),
        kept.groupBy("image", F.expr("2 * l_linenumber + 1")).agg(F.lit("file_system"), F.min("l_returnflag")),
    ]
    found = image_documents(reduce(DataFrame.union, parts))
    shown = F.transform("document.volume_system.volumes", lambda v: F.concat(v["detail"], F.coalesce(F.concat(F.lit(":"), v["file_system"]["detail"]), F.lit(""))))
    return found.select(
        "image", "fault", F.col("document.detail").alias("described"), F.col("document.volume_system.detail").alias("system"),
        F.col("document.file_system.detail").alias("files"), F.array_join(shown, ",").alias("volumes"),
    )


@query("""WITH r AS (SELECT l_orderkey AS inum, l_linenumber AS nth, min(l_partkey) AS addr, min(l_quantity)::BIGINT AS len, CASE WHEN min(l_returnflag) = 'R' THEN 'Sparse' WHEN min(l_returnflag) = 'N' AND l_linenumber = 2 THEN 'Filler' ELSE '' END AS flags
FROM lineitem GROUP BY l_orderkey, l_linenumber), e AS (SELECT *, CASE WHEN flags = 'Filler' THEN 0 ELSE len END * 512 AS own, (sum(CASE WHEN flags = 'Filler' THEN 0 ELSE len END * 512) OVER (PARTITION BY inum ORDER BY nth))::BIGINT AS file_end FROM r)
SELECT inum, nth, file_end - own AS file_begin, file_end, CASE WHEN flags <> 'Sparse' THEN addr END AS disk_begin, CASE WHEN flags <> 'Sparse' THEN addr + len END AS disk_end,
file_end - greatest(file_end - own, least(file_end, 20000)) AS slack FROM e""")
def data_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as the data runs of a file."""
    kind = F.when(F.min("l_returnflag") == "R", "Sparse").when((F.min("l_returnflag") == "N") & (F.col("nth") == 2), "Filler").otherwise("")
    li = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "inum", "l_linenumber": "nth"})
    runs = li.groupBy("inum", "nth").agg(F.min("l_partkey").alias("addr"), F.min("l_quantity").cast("long").alias("len"), kind.alias("flags")).withColumn("init_size", F.lit(20_000))
    return run_layout(runs, 512)
