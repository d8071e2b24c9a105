from __future__ import annotations

import struct

from quarrymill.functions.blake3 import blake3_hex
from quarrymill.functions.identities import identity, with_identity

RUN = {"offset": 8, "addr": 77, "len": 6, "flags": "Dotted"}
STREAM = {"id": 9, "type": 128, "size": 40, "name": "Ann", "flags": "Blue", "data_id": "(*)"}
ATTR = {"stream": STREAM, "rd_buf_size": 2, "rd_buf": "0a0b", "nrd_allocsize": 11, "nrd_skiplen": 12, "nrd_compsize": 13, "nrd_initsize": 14, "nrd_runs": [RUN, {**RUN, "addr": 78}]}
INODE = {"addr": 31, "flags": "Allocated", "link": "to", "nlink": 2, "seq": 3, "type": "File", "uid": "5", "gid": "6", "attrs": [ATTR]}


def numbers(*n):
    return struct.pack(f"<{len(n)}Q", *n)


def test_identities():
    """Digests of bytes laid out by hand: numbers, texts that end with NUL, and digests of the records within."""
    run = blake3_hex(numbers(8, 77, 6) + b"Dotted\0")
    assert identity(RUN, "run") == run
    stream = blake3_hex(numbers(9) + struct.pack("<I", 128) + numbers(40) + b"Ann\0Blue\0(*)\0")
    assert identity(STREAM, "stream") == stream
    other = blake3_hex(numbers(8, 78, 6) + b"Dotted\0")
    attr = blake3_hex(numbers(14, 13, 12, 11) + b"0a0b\0" + numbers(2) + bytes.fromhex(stream + run + other))
    assert identity(ATTR, "attr") == attr
    assert identity(INODE, "inode") == blake3_hex(numbers(31) + b"Allocated\0File\0005\0006\0to\0" + numbers(2, 3) + bytes.fromhex(attr))


def test_over_a_table(spark):
    runs = spark.createDataFrame([(8, 77, 6, "Dotted"), (4, 5, 6, "")], "offset long, addr long, len long, flags string")
    found = {r["offset"]: r["Id"] for r in with_identity(runs, "run").collect()}
    assert found[8] == identity(RUN, "run") != found[4]
    attrs = spark.createDataFrame([ATTR], "nrd_initsize long, nrd_compsize long, nrd_skiplen long, nrd_allocsize long, rd_buf string, rd_buf_size long, stream struct<id:long,type:int,size:long,name:string,flags:string,data_id:string>, nrd_runs array<struct<offset:long,addr:long,len:long,flags:string>>")
    assert with_identity(attrs, "attr").first()["Id"] == identity(ATTR, "attr")
