"""SimHash near-dedup by pigeonhole blocks.

Words are runs of bytes that are not white space, after lower-casing A-Z; a shingle is three
words joined by spaces (fewer words: all of them; none: the fingerprint is zero). A bit of the
64-bit fingerprint is set when more than half the shingles' XXH64 (seed 42) have it.

Fingerprints within 3 bits are linked. A fingerprint is cut into BLOCKS blocks; of any two that
differ in at most 3 bits, BLOCKS - 3 blocks are equal, so each fingerprint is sent to every
choice of BLOCKS - 3 blocks and meets all its partners. In a meeting only a spanning forest of
the links is kept, never all pairs: small meetings compare directly, large ones split again by
the same rule on the bits that are left. Components then follow from those forests.

A null text counts as empty; empty documents share the fingerprint zero and are linked like
any other. The fingerprint is of the whole text, of any length. Rows of equal fingerprint, ties
and repeated rows among them, meet once and share a component; each row is returned. A null id
is never the smallest: a component that only such rows have is null. Extra columns, whatever
their names, are ignored. An empty table gives an empty result.

keep_one() returns rows: of each component one stays, that with the smallest id (null last)
and, of several, the one with the smallest digest of its raw text; of rows equal in id and text
one stays. All columns are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._components import components
from ._tables import checkpoints, row_key, rows_of, spread, table

SHINGLE = 3
DISTANCE = 3
BLOCKS = 5
#: A meeting of more fingerprints than this is split again instead of compared directly.
DIRECT = 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POP = np.array([bin(i).count("1") for i in range(65536)], np.uint8)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _read8(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as little-endian numbers; data has 8 bytes of padding."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    return np.ascontiguousarray(eight[at]).view("<u8").ravel()


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each data[start:end], by numpy for all strings of one length class at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = end - start
    out = np.zeros(len(start), np.uint64)
    lanes = size // 8
    lanes[size >= 32] += 4  # apart from the short ones
    order = np.argsort(lanes, kind="stable")
    cuts = np.flatnonzero(np.diff(lanes[order])) + 1
    for rows in np.split(order, cuts):
        if not len(rows):
            continue
        at, n = start[rows].copy(), size[rows]
        if n[0] >= 32:
            stripes = n // 32
            v = [np.full(len(rows), (seed + k) & (2**64 - 1), np.uint64) for k in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
            for s in range(int(stripes.max())):
                live = np.flatnonzero(stripes > s)
                for lane in range(4):
                    v[lane][live] = _rotl(v[lane][live] + _read8(padded, at[live] + 8 * lane) * _P2, 31) * _P1
                at[live] += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for lane in range(4):
                h = (h ^ (_rotl(v[lane] * _P2, 31) * _P1)) * _P1 + _P4
        else:
            h = np.full(len(rows), (seed + int(_P5)) & (2**64 - 1), np.uint64)
        h = h + n.astype(np.uint64)
        left = n % 32 if n[0] >= 32 else n.copy()
        while (live := np.flatnonzero(left >= 8)).size:
            h[live] = _rotl(h[live] ^ (_rotl(_read8(padded, at[live]) * _P2, 31) * _P1), 27) * _P1 + _P4
            at[live] += 8
            left[live] -= 8
        live = np.flatnonzero(left >= 4)
        if live.size:
            four = _read8(padded, at[live]) & np.uint64(0xFFFFFFFF)
            h[live] = _rotl(h[live] ^ (four * _P1), 23) * _P2 + _P3
            at[live] += 4
            left[live] -= 4
        while (live := np.flatnonzero(left > 0)).size:
            h[live] = _rotl(h[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
            at[live] += 1
            left[live] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        out[rows] = h
    return out


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of a column (bytes and row starts), as uint64."""
    start, end, first = _text.words(data, off)
    rows = len(off) - 1
    out = np.zeros(rows, np.uint64)
    if not len(start):
        return out
    # All words of the column, lower-cased and joined by single spaces.
    size = end - start
    keep = np.zeros(len(data) + 1, bool)
    keep[:-1] = ~_text.WHITE[data]
    keep[end] = True  # the byte after each word becomes its space
    flat = np.concatenate([_LOWER[data], [np.uint8(32)]])
    flat[end] = 32
    if np.any(end[:-1] == start[1:]):  # words of neighbouring rows touch: there is no byte for the space
        flat = np.frombuffer(b" ".join(_LOWER[data[s:e]].tobytes() for s, e in zip(start.tolist(), end.tolist())), np.uint8)
    else:
        flat = flat[keep]
    to = np.cumsum(size + 1) - 1
    frm = to - size
    count = np.diff(first)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    base = np.repeat(first[:-1], shingles)
    place = np.concatenate([[0], np.cumsum(shingles)])
    i = base + np.arange(place[-1]) - np.repeat(place[:-1], shingles)
    j = i + np.repeat(np.minimum(count, SHINGLE), shingles) - 1
    h = xxh64(flat, frm[i], to[j])
    bits = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for r in np.flatnonzero(shingles):
        mine = bits[place[r] : place[r + 1]]
        ones = np.unpackbits(mine, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(ones * 2 > len(mine), bitorder="little").view("<u8")[0]
    return out


def _batches(ids_and_texts: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about so many bytes of text at most (a longer text is alone)."""
    for batch in ids_and_texts:
        size = np.diff(_text.column_bytes(batch.column(1))[1])
        lot = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in _batches(batches):
            fp = fingerprints(*_text.column_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number); keyed: and the row's key."""
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[row_key(doc_id, text).alias("key")] * keyed)
    return thin.mapInArrow(_fingerprint_rows, "doc_id long, fp long" + ", key binary" * keyed)


def _popcount(x: np.ndarray) -> np.ndarray:
    parts = np.ascontiguousarray(x).view(np.uint16).reshape(*x.shape, 4)
    return _POP[parts].sum(axis=-1, dtype=np.int64)


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(b) for b in np.array_split(np.array(bits), parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << int(b) for b in bits)


class _Forest:
    """Union-find over the fingerprints of one meeting."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _meet(fps: np.ndarray, who: np.ndarray, bits: list[int], forest: _Forest) -> None:
    """Link members that differ in at most DISTANCE bits, all of them among the given bits."""
    n = len(who)
    if n < 2:
        return
    if n <= DIRECT or len(bits) < 2 * (DISTANCE + 1):
        mine = fps[who]
        step = max(1, (1 << 20) // n)
        for at in range(0, n, step):
            near = _popcount(mine[at : at + step, None] ^ mine[None, :]) <= DISTANCE
            for a, b in zip(*np.nonzero(near)):
                if a + at < b:
                    forest.link(int(who[a + at]), int(who[b]))
        return
    for block in _blocks(bits, DISTANCE + 1):
        key = fps[who] & np.uint64(_mask(block))
        order = np.argsort(key, kind="stable")
        rest = [b for b in bits if b not in set(block)]
        for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(run) > 1:
                _meet(fps, who[run], rest, forest)


def _plans() -> list[tuple[int, list[int]]]:
    """For each choice of blocks that agree: their mask, and the bits that may differ."""
    blocks = _blocks(list(range(64)), BLOCKS)
    out = []
    for choice in combinations(range(BLOCKS), BLOCKS - DISTANCE):
        same = [b for i in choice for b in blocks[i]]
        out.append((_mask(same), [b for b in range(64) if b not in set(same)]))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the meetings in one partition, which comes sorted by (plan, key)."""
    plans = _plans()

    def forest_of(plan: int, fps: np.ndarray) -> tuple[list[int], list[int]]:
        forest = _Forest(len(fps))
        _meet(fps.view(np.uint64), np.arange(len(fps)), plans[plan][1], forest)
        return [int(fps[a]) for a, _ in forest.links], [int(fps[b]) for _, b in forest.links]

    held: list[np.ndarray] = []  # the last meeting may go on in the next batch
    for batch in _and_end(batches):
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch is not None else [np.zeros(0, np.int64)] * 3
        if held:
            now = [np.concatenate([h, c]) for h, c in zip(held, now)]
        plan, key, fp = now
        if not len(plan):
            held = []
            continue
        cuts = np.flatnonzero((np.diff(plan) != 0) | (np.diff(key) != 0)) + 1
        edges = np.concatenate([[0], cuts, [len(plan)]])
        whole = len(edges) - 1 if batch is None else len(edges) - 2
        tail = edges[whole]
        a, b = [], []
        sizes = np.diff(edges)[:whole]
        # Pairs, by far the most common meetings, are compared all at once.
        two = edges[:whole][sizes == 2]
        near = _popcount((fp[two] ^ fp[two + 1]).view(np.uint64)) <= DISTANCE
        a += fp[two[near]].tolist()
        b += fp[two[near] + 1].tolist()
        for s, n in zip(edges[:whole][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = forest_of(int(plan[s]), fp[s : s + n])
            a += x
            b += y
        held = [c[tail:] for c in now] if batch is not None else []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _grouped(rows: DataFrame) -> DataFrame:
    """fp, root (the component's least fingerprint) and least (its smallest id) of every fingerprint of rows (doc_id, fp)."""
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    keys = F.array(*[F.struct(F.lit(i).alias("plan"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("key")) for i, (m, _) in enumerate(_plans())])
    met = first.select("fp", F.explode(keys).alias("k")).select("k.plan", "k.key", "fp")
    roots = components(met.repartition("plan", "key").sortWithinPartitions("plan", "key").mapInArrow(_links, "a long, b long"))
    known = first.join(roots, first.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("rep").alias("least"))
    return known.join(least, "root").select("fp", "root", "least")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row."""
    checkpoints(docs.sparkSession)
    rows = with_fingerprints(docs, doc_id, text).checkpoint()
    return rows.join(_grouped(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns of docs."""
    checkpoints(docs.sparkSession)
    rows = with_fingerprints(docs, doc_id, text, keyed=True).checkpoint()
    first = rows.join(_grouped(rows), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    return rows_of(docs, first.select("first.key"), doc_id, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spread(table(spark, sf_dir, "documents")))
