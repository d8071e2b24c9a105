"""BLAKE3-256 in Python, for identities of rules and records; Spark has no such function.

Whole contents go through it only when a rule or a caller asks for the blake3 column.
"""

from __future__ import annotations

import struct

# Fixed values of the published algorithm: initial state, message order of the next round, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
_LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_M = 0xFFFFFFFF


def _compress(chain, words, counter: int, size: int, flags: int) -> list[int]:
    v = [*chain, *IV[:4], counter & _M, counter >> 32, size, flags]
    for turn in range(7):
        for lane, (a, b, c, d) in enumerate(_LANES):
            for x, r, s in ((words[2 * lane], 16, 12), (words[2 * lane + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & _M
                t = v[d] ^ v[a]
                v[d] = (t >> r | t << 32 - r) & _M
                v[c] = (v[c] + v[d]) & _M
                t = v[b] ^ v[c]
                v[b] = (t >> s | t << 32 - s) & _M
        words = [words[i] for i in ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, last: int) -> list[int]:
    chain, blocks = IV, [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, block in enumerate(blocks):
        flags = CHUNK_START * (i == 0) | (CHUNK_END | last) * (i == len(blocks) - 1)
        chain = _compress(chain, struct.unpack("<16I", block.ljust(64, b"\0")), counter, len(block), flags)
    return chain


def _tree(data: bytes, counter: int, last: int) -> list[int]:
    chunks = -(-len(data) // 1024)
    if chunks <= 1:
        return _chunk(data, counter, last)
    left = 1 << (chunks - 1).bit_length() - 1
    pair = _tree(data[: left * 1024], counter, 0) + _tree(data[left * 1024 :], counter + left, 0)
    return _compress(IV, pair, 0, 64, PARENT | last)


def blake3_hex(data: bytes) -> str:
    return struct.pack("<8I", *_tree(data, 0, ROOT)).hex()


def field_bytes(*fields: str | int | bytes) -> bytes:
    """Fields of a record for an identity: text ends with NUL, numbers are little-endian 64-bit, bytes go as they are."""
    return b"".join(f if isinstance(f, bytes) else struct.pack("<Q", f) if isinstance(f, int) else f.encode() + b"\0" for f in fields)


def record_id(*fields: str | int | bytes) -> str:
    return blake3_hex(field_bytes(*fields))
