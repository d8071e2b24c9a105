"""Identities of nested file-system records: BLAKE3 of their fields in a fixed order."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

from quarrymill.functions.blake3 import blake3_hex, field_bytes
from quarrymill.functions.blake3_lanes import blake3_each

# The fields of each kind of record in the order in which they are hashed. u64 and u32 are little-endian numbers, text ends with NUL,
# texts is a list of them, and the name of a kind stands for the digest of a record of it (or of each, if the field is a list).
LAYOUTS = {
    "run": (("offset", "u64"), ("addr", "u64"), ("len", "u64"), ("flags", "text")),
    "stream": (("id", "u64"), ("type", "u32"), ("size", "u64"), ("name", "text"), ("flags", "text"), ("data_id", "text")),
    "attr": (
        ("nrd_initsize", "u64"), ("nrd_compsize", "u64"), ("nrd_skiplen", "u64"), ("nrd_allocsize", "u64"), ("rd_buf", "text"), ("rd_buf_size", "u64"), ("stream", "stream"), ("nrd_runs", "run"),
    ),
    "inode": (
        ("addr", "u64"), ("flags", "text"), ("type", "text"), ("uid", "text"), ("gid", "text"), ("link", "text"), ("nlink", "u64"), ("seq", "u64"), ("attrs", "attr"),
    ),
    "entry": (("type", "text"), ("path", "text"), ("streams", "texts"), ("children", "texts")),
}


def _bytes(value: object, kind: str) -> bytes:
    if kind in ("u64", "text"):
        return field_bytes(value)
    if kind == "u32":
        return struct.pack("<I", value)
    if kind == "texts":
        return field_bytes(*value)
    records = [value] if isinstance(value, Mapping) or hasattr(value, "asDict") else value
    return b"".join(bytes.fromhex(identity(r, kind)) for r in records)


def identity(record: Mapping, kind: str) -> str:
    """Hex identity of a record (a mapping, or a Row of the same shape)."""
    return blake3_hex(b"".join(_bytes(record[f], k) for f, k in LAYOUTS[kind]))


def with_identity(records: DataFrame, kind: str) -> DataFrame:
    """records (columns as in the layout, nested as structs and arrays) with a column Id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(Id=[identity(r, kind) for r in b.to_dict("records")])

    shape = ", ".join(f"`{c}` {t}" for c, t in records.dtypes)
    return records.mapInPandas(run, f"{shape}, Id string")


def with_record_id(dirent: DataFrame) -> DataFrame:
    """Directory entries with Id, from all their other columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rest = b.drop(columns="Id").astype(object)
            yield b.assign(Id=blake3_each([field_bytes(*row) for row in rest.itertuples(index=False, name=None)]))

    return dirent.mapInPandas(run, dirent.schema)


def with_inode_id(inode: DataFrame) -> DataFrame:
    """Inodes with Id, from the columns that identify one; they have no attributes here."""
    names = {"addr": "Addr", "flags": "Flags", "type": "Type", "uid": "Uid", "gid": "Gid", "link": "LinkTarget", "nlink": "NumLinks", "seq": "SeqNum"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b[list(names.values())].astype(object).itertuples(index=False, name=None)
            records = ({**dict(zip(names, row)), "attrs": []} for row in rows)
            yield b.assign(Id=[identity({**r, "uid": str(r["uid"]), "gid": str(r["gid"])}, "inode") for r in records])

    return inode.mapInPandas(run, inode.schema)
