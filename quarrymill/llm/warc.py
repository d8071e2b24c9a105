"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Readers get byte ranges. A task looks for gzip magic in its range, accepts a candidate only if the member decodes to a WARC header (and, at its end,
passes its checksum), owns the records that start in its range, and reads past the range's end to finish the last one. After an
accepted member the search goes on at the member's end, so bytes inside members are not taken for records. Nor are archives inside a payload in which a range
begins: members have to follow each other from the range's first one on to its end. Where they break off, either an archive inside a payload or a damaged one has ended; then the
task looks before its range for the member that holds the first one.

Files are opened with pyarrow.fs, which reaches local and shared folders, HDFS (with its native library) and object stores.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bound_batches, read_table, shared_dir, slots, stage

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are written again rather than revisited.
LEAST_REVISITED = 1000
ROLL, RANGE, CHUNK = 256 << 20, 32 << 20, 64 << 10
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _writer(folder: str, roll: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _open(folder)
        out, path, size, done = None, "", 0, []
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"]):
                if out is None:
                    # A name of its own for each attempt: what a lost task left behind is in no list of files.
                    path, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                record = _record(None if pd.isna(page_id) else int(page_id), url if isinstance(url, str) else None, bytes(html), digest, None if pd.isna(refers_to) else int(refers_to))
                out.write(record)
                size += len(record)
                if size >= roll:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        yield pd.DataFrame(done, columns=["path", "bytes"])

    return write


def write_warc(pages: DataFrame, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the archives: path and bytes.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of at least 1000 bytes the one with the largest page_id
    is a response and the others revisit it (rows that repeat that page_id are responses too; rows without a page_id always are); smaller ones are all responses. Extra columns are
    ignored; an empty table gives no archive. Payloads are equal when SHA-1, XXH64 and length are.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, top = _open(folder)
    fs.create_dir(top, recursive=True)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "check": F.xxhash64("payload"), "size": F.octet_length("payload")})
    same = ["digest", "check", "size"]
    groups = rows.where(F.col("size") >= LEAST_REVISITED).groupBy(*same).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # One row per repeated payload on the right, so Spark can split a payload that very many pages share.
    marked = rows.join(groups, same, "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("last"), F.col("last")))
    written = marked.select("page_id", "url", "payload", "digest", "refers_to").mapInPandas(_writer(folder, roll), "path string, bytes long")
    return stage(written, "archives")


def members(source, start: int, end: int) -> Iterator[bytes]:
    """Decoded WARC records of the gzip members that begin in [start, end) of an open file."""
    limit = source.size()
    base, held, at = start, b"", start  # held: the file's bytes from base on; at: where to search next

    def upto(stop: int) -> None:
        nonlocal held
        missing = min(stop, limit) - (base + len(held))
        if missing > 0:
            held += source.read_at(max(missing, min(CHUNK, limit - base - len(held))), base + len(held))

    first = start > 0
    while at < end:
        if at - base > CHUNK:
            held, base = held[at - base :], at
        upto(at + CHUNK)
        found = held.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(held) - len(MAGIC) + 1)
            if base + len(held) >= limit:
                return
            continue
        at = base + found
        if at >= end:
            return
        record, after = _decode(upto, lambda: (base, held), at, limit)
        if record is not None and first:
            if not _stands_alone(source, start, at, after, end):
                at = after
                continue
            first = False
        if record is None:
            at += 1
        else:
            yield record
            at = after


def _member_at(source, at: int) -> int | None:
    """Where the member that begins at a place of a file ends; None if none does."""
    held, limit = b"", source.size()

    def upto(stop: int) -> None:
        nonlocal held
        if (missing := min(stop, limit) - at - len(held)) > 0:
            held += source.read_at(missing, at + len(held))

    record, after = _decode(upto, lambda: (at, held), at, limit)
    return None if record is None else after


def _stands_alone(source, start: int, at: int, after: int, end: int) -> bool:
    """Whether the member from at to after, the first one in a range that begins inside a file, is not inside the payload of another one."""
    limit, last = source.size(), after
    while last < min(end, limit):
        further = _member_at(source, last)
        if further is None:
            break
        last = further
    else:
        return True
    stop, width = start, CHUNK
    while stop > 0:
        low = max(0, stop - width)
        piece = source.read_at(min(stop + len(MAGIC) - 1, limit) - low, low)
        found = piece.rfind(MAGIC)
        while found >= 0:
            inside = low + found
            while inside is not None and inside < at:
                inside = _member_at(source, inside)
            if inside is not None:
                # Members follow each other to this one, or one of them goes on beyond it.
                return inside == at
            found = piece.rfind(MAGIC, 0, found + len(MAGIC) - 1)
        stop, width = low, 2 * width
    return True


def _decode(upto, view, at: int, limit: int) -> tuple[bytes | None, int]:
    """The record of the member at `at` and the position behind it; None if it is no member with a WARC header."""
    unpack, parts, seen, pos = zlib.decompressobj(wbits=31), [], 0, at
    try:
        while not unpack.eof:
            upto(pos + CHUNK)
            base, held = view()
            data = held[pos - base : pos - base + CHUNK]
            if not data:
                return None, at
            parts.append(unpack.decompress(data))
            pos += len(data)
            if not seen and (head := b"".join(parts)):
                if not (head[:7] + b"WARC/1."[len(head) :]) == b"WARC/1.":
                    return None, at
                seen = len(head) >= 7
    except zlib.error:
        return None, at
    record = b"".join(parts)
    return (record if record[:7] == b"WARC/1." else None), pos - len(unpack.unused_data)


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode() for k, v in (x.split(b":", 1) for x in lines if b":" in x)}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _unescape(url: str | None) -> str | None:
    from urllib.parse import unquote

    return None if url is None else unquote(url)


def parse_record(record: bytes) -> tuple:
    """The columns RECORDS of one decoded record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _fields(head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    size = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = warc["warc-type"]
    return _page(warc["warc-record-id"]), _unescape(warc.get("warc-target-uri")), kind, _page(warc.get("warc-refers-to")), payload if kind == "response" else None, size, digest


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    for b in batches:
        for uri, start, end in zip(b["uri"], b["start"], b["end"]):
            fs, path = _open(uri)
            rows, held = [], 0
            with fs.open_input_file(path) as source:
                for record in members(source, int(start), int(end)):
                    rows.append(parse_record(record))
                    held += len(record)
                    if held > 16 << 20:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)


def read_warc(archives: DataFrame, scheme: str = "file://", range_bytes: int = RANGE) -> DataFrame:
    """Records (columns RECORDS) of archives (path, bytes), read by byte ranges of range_bytes.

    Members that are damaged are left out. A revisit has no payload; its payload_bytes and payload_digest are those of the payload it stands for. A page_id that is not an integer reads as
    null. No archives give no records.
    """
    spark = archives.sparkSession
    starts = archives.where("bytes > 0").select(F.concat(F.lit(scheme), "path").alias("uri"), "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.select("uri", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    return ranges.repartition(slots(spark), "uri", "start").mapInPandas(_read, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    scheme = re.match(r"(?:\w+:/{2}[^/]*)?", folder)[0]
    records = read_warc(write_warc(read_table(spark, sf_dir, "pages"), folder), scheme)
    full = F.col("payload").isNotNull()
    return records.select(
        "page_id",
        F.when(full, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT page_id, html, n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
