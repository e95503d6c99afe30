"""Vectorised text kit: words, hashes of substrings and blobs over Arrow columns.

Everything works on the UTF-8 bytes of a whole Arrow string column at once, so the cost
per word is a few numpy passes and no Python loop touches a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    off = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are not white space, and each row's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~WHITE[data]
    before = np.zeros(n, bool)
    before[1:] = ink[:-1]
    edge = off[:-1]
    before[edge[edge < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = ink[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(ink & ~before)
    end = np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(start, off)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit values, to hash any run of them in constant time."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of values[start:end] for arrays of starts and ends."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


#: Bytes that word_hash() works on at a time.
SPAN = 1 << 20


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words in ascending order, stretch by stretch, so that little is held beside them."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + SPAN, side="right")))
        lo = start[a]
        out[a:b] = run_hash(prefix_hash(byte_values(data[lo : end[b - 1]])), start[a:b] - lo, end[a:b] - lo)
        a = b
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """The row of each word, given each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unique 64-bit values as differences of as few bytes as fit."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    head = int(steps[0]).to_bytes(8, "little")
    steps = steps[1:]
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + head + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width] = body
    steps = steps.view("<u8").ravel()
    steps[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(steps, dtype=np.uint64)


def bucket_edges(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of equal ranges of the 64-bit space begins in ascending values."""
    cuts = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, cuts), [len(values)]])
