"""BLAKE3-256 of many contents at once: chunks of all contents are lanes of NumPy arrays, and so are the parents of each level of their trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from quarrymill.functions.blake3 import CHUNK_END, CHUNK_START, IV, ORDER, PARENT, ROOT

CHUNK, BLOCK = 1024, 64
#: Chunks that are compressed together; their state stays in the processor's cache, and contents of any length need no more room.
LANES = 4096
_IV = np.array(IV, np.uint32)[:, None]


def _schedule() -> list[list[int]]:
    """Which words each of the seven rounds takes, in their order."""
    words = [list(range(16))]
    for _ in range(6):
        words.append([words[-1][i] for i in ORDER])
    return words


_WORDS = _schedule()


def _turned(x: np.ndarray, right: int) -> np.ndarray:
    return x >> np.uint32(right) | x << np.uint32(32 - right)


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray | int, flags: np.ndarray | int) -> np.ndarray:
    """Chaining values (8, n) of n blocks: chain (8, n), words (16, n), counter (n,)."""
    n = words.shape[1]
    a, b, c = chain[:4].copy(), chain[4:].copy(), np.repeat(_IV[:4], n, axis=1)
    d = np.empty((4, n), np.uint32)
    d[0], d[1], d[2], d[3] = counter & 0xFFFFFFFF, counter >> np.uint64(32), size, flags
    for order in _WORDS:
        for way in (0, 1):
            part = order[8 * way : 8 * way + 8]
            if way:  # diagonals are columns of rows that are shifted against each other
                b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]
            for x, r, s in ((words[part[0::2]], 16, 12), (words[part[1::2]], 8, 7)):
                a += b
                a += x
                d = _turned(d ^ a, r)
                c += d
                b = _turned(b ^ c, s)
            if way:
                b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
    return np.concatenate([a ^ c, b ^ d])


def _chunks(data: np.ndarray, sizes: np.ndarray, counter: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of chunks: data (n, 1024) bytes padded with zeros, their sizes, their number in their content, and whether they are all of it."""
    words = data.view("<u4").reshape(len(data), 16, 16)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    chain = np.repeat(_IV, len(data), axis=1)
    for i in range(int(blocks.max())):
        now = np.flatnonzero(blocks > i)
        last = blocks[now] == i + 1
        flags = CHUNK_START * (i == 0) + CHUNK_END * last + ROOT * (last & single[now])
        filled = np.clip(sizes[now] - BLOCK * i, 0, BLOCK)
        # Words of a block in rows, so that each row of lanes lies in one piece.
        chain[:, now] = _compress(chain[:, now], np.ascontiguousarray(words[now, i].T), counter[now], filled, flags)
    return chain


def _cut(contents: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of all contents, LANES at a time, as _chunks() takes them."""
    data, sizes, counter, single = np.zeros((LANES, CHUNK), np.uint8), np.zeros(LANES, np.int64), np.zeros(LANES, np.uint64), np.zeros(LANES, bool)
    used = 0
    for content in contents:
        whole, n = np.frombuffer(content, np.uint8), max(1, -(-len(content) // CHUNK))
        at = 0
        while at < n:
            take = min(LANES - used, n - at)
            piece = whole[at * CHUNK : (at + take) * CHUNK]
            rows = slice(used, used + take)
            flat = data[rows].reshape(-1)
            flat[: len(piece)], flat[len(piece) :] = piece, 0
            sizes[rows] = np.clip(len(content) - CHUNK * np.arange(at, at + take), 0, CHUNK)
            counter[rows], single[rows] = np.arange(at, at + take), n == 1
            at, used = at + take, used + take
            if used == LANES:
                yield data, sizes, counter, single
                used = 0
    if used:
        yield data[:used], sizes[:used], counter[:used], single[:used]


def blake3_each(contents: Sequence[bytes]) -> list[str]:
    """Lower-case hex digest of each content."""
    if not contents:
        return []
    nodes = np.concatenate([_chunks(*x) for x in _cut(contents)], axis=1)
    counts = np.array([max(1, -(-len(x) // CHUNK)) for x in contents])
    # Neighbours are joined level by level; the last of an odd number goes up as it is, which gives the tree whose left sides are full.
    while counts.max() > 1:
        first = np.cumsum(counts) - counts
        above = -(-counts // 2)
        nth = np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
        left = np.repeat(first, above) + 2 * nth
        paired = 2 * nth + 1 < np.repeat(counts, above)
        up = nodes[:, left]
        at = left[paired]
        flags = PARENT + ROOT * (np.repeat(counts, above)[paired] == 2)
        for i in range(0, len(at), LANES):
            some = at[i : i + LANES]
            words = np.concatenate([nodes[:, some], nodes[:, some + 1]])
            up[:, np.flatnonzero(paired)[i : i + LANES]] = _compress(np.repeat(_IV, len(some), axis=1), words, np.zeros(len(some), np.uint64), BLOCK, flags[i : i + LANES])
        nodes, counts = up, above
    return [x.tobytes().hex() for x in np.ascontiguousarray(nodes.T.astype("<u4"))]
