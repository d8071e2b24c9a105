"""Readable values: flags, types and times of file systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by flag bit or by code, in the order in which they are listed.
META_FLAGS = {1: "Allocated", 2: "Deleted", 4: "Used", 8: "Unused", 16: "Compressed", 32: "Orphan"}
NAME_FLAGS = {1: "Allocated", 2: "Deleted"}
ATTRIBUTE_FLAGS = {1: "In Use", 2: "Non-resident", 4: "Resident", 16: "Encrypted", 32: "Compressed", 64: "Sparse", 128: "Recovered"}
RUN_FLAGS = {1: "Filler", 2: "Sparse"}
PARTITION_FLAGS = {1: "Allocated", 2: "Unallocated", 4: "Volume System"}
FILE_SYSTEM_FLAGS = {1: "Sequenced", 2: "Nanosecond precision"}
NAME_TYPES = {
    0: "Undefined", 1: "Named Pipe", 2: "Character Device", 3: "Folder", 4: "Block Device", 5: "File", 6: "Symbolic Link",
    7: "Domain Socket", 8: "Shadow Inode", 9: "Whiteout Inode", 10: "Virtual", 11: "Virtual Folder",
}
VOLUME_SYSTEMS = {0: "Unknown", 1: "MBR", 2: "BSD", 4: "Sun", 8: "Macintosh", 16: "GPT"}


def flag_labels(bits: Column, labels: dict[int, str]) -> Column:
    """Labels of the bits that are set, with a comma and a space between; none give the empty string."""
    return F.concat_ws(", ", *[F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(label)) for bit, label in labels.items()])


def label_of(code: Column, labels: dict[int, str], other: str = "") -> Column:
    first, *rest = labels.items()
    chain = reduce(lambda c, x: c.when(code == x[0], x[1]), rest, F.when(code == first[0], first[1]))
    return chain.otherwise(other)


def format_timestamp(seconds: Column, nanos: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` in UTC, with the fraction of a second without trailing zeros; empty if both are 0.

    Days and seconds are added to 1970 by arithmetic, so the session's time zone does not matter. Years have four digits, or as many as they need: 10000 has no sign,
    and the year before 1 is 0000.
    """
    day, second = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600).cast("int"), F.floor(second / 60).cast("int") % 60, (second % 60).cast("int"))
    on = F.date_add(F.lit("1970-01-01").cast("date"), day)
    year = F.year(on).cast("string")
    date = F.concat(F.when(F.year(on).between(0, 9999), F.lpad(year, 4, "0")).otherwise(year), F.date_format(on, "-MM-dd"))
    fraction = F.when(nanos.between(1, 999_999_999), F.concat(F.lit("."), F.rtrim(F.lpad(nanos.cast("string"), 9, "0"), F.lit("0")))).otherwise("")
    return F.when((seconds == 0) & (nanos == 0), "").otherwise(F.concat(date, F.lit(" "), clock, fraction))


def up_to_nul(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def file_system_id(raw: Column, little_endian: Column) -> Column:
    """Hex of an identifier's bytes, turned round if they are little-endian."""
    digits = F.lower(F.hex(raw))
    turned = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit(".."), F.lit(0))), "")
    return F.when(little_endian, turned).otherwise(digits)
