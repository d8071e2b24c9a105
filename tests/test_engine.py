from __future__ import annotations

import pytest

from quarrymill import cli
from quarrymill.engine import Engine
from quarrymill.functions.blake3 import record_id
from quarrymill.sources.files import DIRENT, HASH, INODE, directory_files, folders_of
from quarrymill.streaming.scan import first_seen, scan_stream, watch


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"some needle here")
    (tmp_path / "in" / "sub" / "b.txt").write_bytes(b"needle needle")
    (tmp_path / "in" / "sub" / "c.txt").write_bytes(b"hay")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "good").write_text('rule two { grep: patterns: a = "needle" condition: count(a) > 1 } rule bad {')
    (tmp_path / "rules" / "more").write_text('rule any { grep: patterns: a = "needle" condition: any() }')
    return tmp_path


def test_scan_and_export(spark, folder):
    engine = Engine(spark).load_rule_folder(str(folder / "rules"))
    assert [r.name for r in engine.rules] == ["two", "any"] and len(engine.errors) == 1
    engine.scan(str(folder / "in")).export(str(folder / "out"))
    read = lambda t: spark.read.parquet(str(folder / "out" / t))
    names = {r["id"]: r["name"] for r in read("rules").collect()}
    assert sorted((names[r["id"]], r["name"]) for r in read("rule_hits").collect()) == [("any", "a.txt"), ("any", "b.txt"), ("two", "b.txt")]
    assert sorted((r["start_offset"], r["length"]) for r in read("search_hits").collect()) == 2 * [(0, 6)] + 2 * [(5, 6)] + 2 * [(7, 6)]
    assert read("hash").count() == 3
    # Three files and the folder below the source, in the full schemas.
    assert sorted((r["Name"], r["Type"]) for r in read("dirent").collect()) == [("a.txt", "File"), ("b.txt", "File"), ("c.txt", "File"), ("sub", "Folder")]
    assert sorted((r["Type"], r["Filesize"]) for r in read("inode").collect()) == [("File", 3), ("File", 13), ("File", 16), ("Folder", 0)]
    assert [read(t).columns for t in ("dirent", "inode", "hash")] == [x.names for x in (DIRENT, INODE, HASH)]
    by_name = {r["Name"]: r for r in read("dirent").collect()}
    assert by_name["b.txt"]["ParentAddr"] == by_name["sub"]["MetaAddr"] and len({r["Id"] for r in by_name.values()}) == 4
    one = by_name["a.txt"]
    assert one["Id"] == record_id(one["Path"], "a.txt", "", "File", "Allocated", one["MetaAddr"], one["ParentAddr"], 0, 0)


def test_patterns_that_cannot_be_read(spark, folder):
    text = 'rule fine { grep: patterns: a = "needle" condition: any() } rule open { grep: patterns: a = "x(" condition: any() } rule blank { grep: patterns: a = "y*" condition: any() }'
    engine = Engine(spark).load_rules(text)
    assert [r.name for r in engine.rules] == ["fine"] and [str(e).split(":")[0] for e in engine.errors] == ["open", "blank"]
    assert engine.scan(str(folder / "in")).rule_hits.count() == 2


def test_folders(spark, folder):
    found = {r["Name"] for r in folders_of(directory_files(spark, str(folder / "in"))).collect()}
    assert {"in", "sub"} <= found


def test_errors(spark, folder):
    with pytest.raises(FileNotFoundError):
        Engine(spark).load_rule_file(str(folder / "none"))
    with pytest.raises(FileNotFoundError):
        Engine(spark).scan(str(folder / "none"))
    with pytest.raises(ValueError, match="codec"):
        Engine(spark).scan(str(folder / "in")).export(str(folder / "o"), "lzo")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["only-one"])


def test_command_line(spark, folder):
    (folder / "words").write_text("hay\n")
    assert cli.main(["-k", str(folder / "words"), "-f", str(folder / "rules" / "more"), str(folder / "out"), str(folder / "in")]) == 0
    assert spark.read.parquet(str(folder / "out" / "rule_hits")).count() == 3


def test_stream(spark, folder):
    engine = Engine(spark).load_rule_file(str(folder / "rules" / "more"))
    run = lambda: scan_stream(engine, watch(spark, str(folder / "in")), str(folder / "out"), str(folder / "state"), once=True).awaitTermination()
    run()
    assert spark.read.parquet(str(folder / "out" / "rule_hits")).count() == 2
    (folder / "in" / "d.txt").write_bytes(b"a needle")
    run()
    assert sorted(r["name"] for r in spark.read.parquet(str(folder / "out" / "rule_hits")).collect()) == ["a.txt", "b.txt", "d.txt"]


def test_files_of_several_batches_are_searched_once(spark, tmp_path):
    """Also when the stream is started again between the batches."""
    engine = Engine(spark).load_rules('rule r { grep: patterns: p = "needle" condition: any() }')
    shape = "Path string, Name string, FsOffset long, Addr long, content binary"

    def arrive(*rows):
        spark.createDataFrame([("/", name, fs, addr, b"a needle") for name, fs, addr in rows], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(key=("FsOffset", "Addr")):
        files = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        scan_stream(engine, first_seen(files, by=key), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
        return sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out" / "rule_hits")).collect())

    arrive(("a", 0, 1), ("b", 0, 2), ("c", None, 3))
    arrive(("a again", 0, 1), ("other system", 9, 1))
    assert run() == ["a", "b", "c", "other system"]
    arrive(("b again", 0, 2), ("d", 0, 4), ("d again", 0, 4), ("c again", None, 3))
    found = run()
    assert found[:3] == ["a", "b", "c"] and found[3] in ("d", "d again") and found[4:] == ["other system"]
    with pytest.raises(ValueError, match="none of the columns"):
        run(("NoSuch",))


def test_command_line_with_signatures(spark, folder):
    (folder / "known.json").write_text('[{"id": "hay", "name": "Hay", "pattern": "hay", "checks": []}]')
    (folder / "by_type").write_text('rule typed { signature: name == "Hay" }')
    found = str(folder / "typed")
    assert cli.main(["-f", str(folder / "by_type"), "-f", str(folder / "rules" / "more"), "-s", str(folder / "known.json"), found, str(folder / "in")]) == 0
    assert sorted(r["name"] for r in spark.read.parquet(f"{found}/rule_hits").collect()) == ["a.txt", "b.txt", "c.txt"]
    with pytest.raises(FileNotFoundError):
        cli.main(["-s", str(folder / "none"), found, str(folder / "in")])
