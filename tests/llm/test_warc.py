from __future__ import annotations

import gzip
import hashlib
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import warc
from quarrymill.llm.warc import OP8_SQL, members, op8_warc, parse_record, read_warc, write_warc

PAGES = [
    (1, "http://a/?x=1&y=\n%41 é", "x" * 1000), (2, "http://b", "x" * 1000), (3, "http://c", "x" * 999), (4, "http://d", "x" * 999), (5, None, None), (6, "http://e", ""),
    (7, "http://f", "é\r\n\r\n" * 400 + "WARC/1.1"), (8, "http://g", "long " * 200_000), (9, "http://b", "x" * 1000), (9, "http://b", "x" * 1000), (None, "http://n", "x" * 1000),
]


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getbuffer())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit("clash"), "digest": F.lit("clash"), "size": F.lit(0)})


@pytest.mark.parametrize("range_bytes", [97, 5_000, 1 << 25])
def test_round_trip(spark, pages, range_bytes):
    archives = write_warc(pages.repartition(3, "page_id"), roll=4_000)
    rows = read_warc(archives, range_bytes=range_bytes).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in rows) == sorted((p or 0, u or "") for p, u, _ in PAGES)
    texts = {p: (t or "").encode() for p, _, t in PAGES}
    for r in rows:
        full = texts[r["page_id"]]
        assert r["payload_bytes"] == len(full) and r["payload_digest"] == hashlib.sha1(full).hexdigest()
        revisit = r["page_id"] in (1, 2)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else full)


def test_standard_tools_can_read_it(pages):
    for r in write_warc(pages).collect():
        with gzip.open(r["path"]) as f:
            assert f.read().startswith(b"WARC/1.1\r\n")


def test_no_pages(pages):
    assert read_warc(write_warc(pages.where("false"))).count() == 0


def test_ranges_own_what_starts_in_them():
    """Members with gzip magic inside, junk between members, every cut: each record is read once."""
    draw = random.Random(8)
    data, at = b"", []
    for i in range(12):
        payload = draw.randbytes(300) + warc.MAGIC + draw.randbytes(200) + (gzip.compress(b"no record") if i % 3 == 0 else b"")
        at.append(len(data))
        data += warc._record(i, "u", payload, "00" * 20, None) + (warc.MAGIC + b"junk" if i % 4 == 0 else b"")
    for size in (1, 7, 100, 1000, len(data)):
        seen = [parse_record(m)[0] for s in range(0, len(data), size) for m in members(Bytes(data), s, min(s + size, len(data)))]
        assert seen == list(range(12)), size


def test_cut_and_broken_archives():
    good = warc._record(1, "u", b"abc" * 500, "00" * 20, None)
    broken = bytearray(good)
    broken[-6] ^= 0xFF
    assert [parse_record(m)[0] for m in members(Bytes(good[:-9]), 0, len(good) - 9)] == []
    assert [parse_record(m)[0] for m in members(Bytes(bytes(broken) + good), 0, 2 * len(good))] == [1]


def test_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = op8_warc(spark, "/root/testdata/sf0.01").select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({OP8_SQL})").fetchall())


def test_archives_inside_payloads_are_no_records():
    """A payload that no compression shortens holds an archive of its own; one member further on is damaged."""
    draw = random.Random(4)
    member = lambda name, payload: gzip.compress(b"WARC/1.1\r\nname: " + name + b"\r\n\r\n" + payload, mtime=0)
    inner = b"".join(member(b"inner%d" % i, draw.randbytes(150)) for i in range(3))
    outer = [member(b"outer%d" % i, draw.randbytes(400) + (inner if i % 2 else b"") + draw.randbytes(300)) for i in range(6)]
    broken = bytearray(outer[4])
    broken[len(broken) // 2] ^= 0x55
    for whole, names in ((outer, {0, 1, 2, 3, 4, 5}), ([*outer[:4], bytes(broken), outer[5]], {0, 1, 2, 3, 5})):
        data = Bytes(b"".join(whole))
        for size in (50, 333, 1_000, 4_000, 10**6):
            found = [r for at in range(0, data.size(), size) for r in members(data, at, min(at + size, data.size()))]
            assert [r.split(b"name: ")[1][:6] for r in found] == [b"outer%d" % i for i in sorted(names)]
