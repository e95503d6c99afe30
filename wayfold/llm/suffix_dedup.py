"""Substring dedup on bytes, by column-wise construction over collections of contexts.

A byte goes when a string of LENGTH bytes that covers it also starts somewhere else, in the
same document or another.

1. Candidates. Of the GRAM-byte strings in each LENGTH-byte window the one with the smallest
   hash (the leftmost of equal ones) is its anchor. Equal windows have equal anchors at equal
   places, so any two copies meet at an anchor. A window reaches at least half of
   LENGTH - GRAM bytes beyond its anchor to the right or to the left; so each anchor stands
   for two cores of GRAM + half bytes, one to each side, and equal windows share a core. Each
   part of the documents sends the hashes of its cores and how often it has them, and learns
   which occur more than once in all. This only rules out; it decides no match.
2. Periodic runs. Where a stretch of LENGTH + g bytes or more repeats itself every g <= GRAM / 2
   bytes (compared byte by byte), each window in it starts again g bytes on or before: all of
   it goes. A window that lies across an end of a periodic stretch has its smallest string at
   that end too (for the right end, the last of equal ones is an anchor as well), and one that
   lies in the stretch is found from its first two periods; other anchors in a long stretch are
   left out, so a run of one letter stands for a few cores and not for one at every byte.
3. Construction. For a core that occurs more than once, the context of each occurrence (the
   core and half bytes on either side) goes to the core's bucket. Equal contexts become one
   document with a count. The documents read from the core's start to the right, mirrored,
   are one collection, and those read to the left another. A collection is built column by
   column: every round inserts one symbol of every document in front of what was inserted
   before, by one stable pass over the current order of suffixes (the symbols passed over are
   the collection's Burrows-Wheeler column), and updates which neighbours still have an equal
   prefix. The columns of the first collection's equal prefixes are written to a sequential
   external file in the task's temporary folder, round by round, and read back from its end
   while the second collection is built, so that memory does not grow with the rounds. After
   round o of the second collection, an occurrence is covered with o bytes to its left if
   another is in the same class there, and in the first collection after the round that
   completes LENGTH. All bytes of a match, the core's too, are compared by the construction.
4. Hot cores. A core with more than HOT occurrences sends no contexts, so that no task gathers
   them: each part sends each distinct window around it once (two independent 64-bit hashes)
   and learns which another part has too. The result is the same; only the place where equal
   windows meet differs, as each window has a key of its own.
5. Each occurrence learns the first and the last byte of the windows found; the union of
   these intervals and of the periodic stretches is removed.

The rounds over bounded buckets stand for the construction on whole documents: there, one
round for every byte of the longest document would rewrite the transform of the whole corpus
each time (README).

A null text is empty. Texts under LENGTH bytes keep all. Texts of any length are hashed in
overlapping stretches. Repeated rows are copies of each other. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _parts, _text
from ._tables import table

LENGTH = 400
GRAM = 100
PART_BYTES = 5 << 20
#: Bytes hashed at a time inside a part, and of a longer document.
LOT_BYTES = 1 << 20
STRETCH_BYTES = 1 << 23
#: Cores in an index bucket and contexts in a bucket of the construction, about.
BUCKET_CORES = 700_000
BUCKET_CONTEXTS = 40_000
#: A core with more occurrences than this meets window by window (bounds a task's memory; same result).
HOT = 20_000


def _anchors(sums: np.ndarray, off: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places of the anchors of all windows of the rows whose bytes the sums are over."""
    n = len(sums) - 1
    span = length - gram + 1  # gram starts in a window
    if n < length:
        return np.zeros(0, np.int64)
    grams = np.arange(n - gram + 1)
    rank = (_text.run_hash(sums, grams, grams + gram) & ~np.uint64((1 << 24) - 1)) | grams.astype(np.uint64)
    # The smallest in each run of span values: from prefix and suffix minima of blocks.
    blocks = -(-len(rank) // span)
    padded = np.full(blocks * span, np.uint64(2**64 - 1))
    padded[: len(rank)] = rank
    square = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[span - 1 : span - 1 + n - length + 1])
    inside = np.zeros(n - length + 2, np.int32)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= length:
            inside[a] += 1
            inside[b - length + 1] -= 1
    whole = np.cumsum(inside[:-1]) > 0
    found = (least[whole] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return np.unique(found)


def _equal_from(a: np.ndarray, b: np.ndarray) -> int:
    """How many symbols from the start two views agree in."""
    n, at = min(len(a), len(b)), 0
    while at < n:
        differ = np.flatnonzero(a[at : at + 4096] != b[at : at + 4096])
        if len(differ):
            return at + int(differ[0])
        at += 4096
    return n


def _without_runs(data: np.ndarray, off: np.ndarray, sums: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Anchors without those inside long periodic stretches but with the last one of any stretch, and the long stretches.

    A string of GRAM bytes lies in one maximal stretch of a period up to GRAM / 2 at most.
    """
    if not len(at):
        return at, []
    end = off[np.searchsorted(off, at, side="right")]
    period = np.zeros(len(at), np.int64)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    word = np.ascontiguousarray(eight[at]).view("<u8").ravel()
    for g in range(1, gram // 2 + 1):
        can = np.flatnonzero((period == 0) & (at + g + gram <= end))
        can = can[np.ascontiguousarray(eight[at[can] + g]).view("<u8").ravel() == word[can]]
        if len(can):
            here = at[can]
            period[can[_text.run_hash(sums, here, here + gram) == _text.run_hash(sums, here + g, here + g + gram)]] = g
    keep, runs, last, left, right = np.ones(len(at), bool), [], [], 0, 0
    for i in np.flatnonzero(period).tolist():
        a, g = int(at[i]), int(period[i])
        if a + g + gram <= right:
            continue  # in the stretch found last
        row = int(np.searchsorted(off, a, side="right")) - 1
        lo, hi = int(off[row]), int(off[row + 1])
        right = a + g + _equal_from(data[a : hi - g], data[a + g : hi])
        left = a - _equal_from(data[lo:a][::-1], data[lo + g : a + g][::-1])
        last.append(a + (right - gram - a) // g * g)
        if right - left >= length + g:
            runs.append((left, right))
            x, y = np.searchsorted(at, [left + 2 * g, right - gram - g + 1])
            keep[x:y] = False
    return (np.union1d(at[keep], last).astype(np.int64) if last else at), runs


def _cores(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of both cores of every anchor (a core that would leave its document is left out), and the periodic stretches."""
    half = (length - gram) // 2
    core = gram + half
    hashes, places, runs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for a, b in _parts.lots(off, LOT_BYTES):
        lo, hi = int(off[a]), int(off[b])
        if hi - lo < length:
            continue
        long = b - a == 1
        for c in range(lo, hi, STRETCH_BYTES) if long else (lo,):  # one very long document: overlapping stretches
            end = min(hi, c + STRETCH_BYTES + 2 * length + gram) if long else hi
            mine = np.array([0, end - c]) if long else off[a : b + 1] - lo
            sums = _text.prefix_hash(_text.byte_values(data[c:end]))
            at, found = _without_runs(data[c:end], mine, sums, _anchors(sums, mine, length, gram), length, gram)
            row = np.searchsorted(mine, at, side="right") - 1
            start = np.concatenate([at, at - half])
            row = np.concatenate([row, row])
            fits = (start >= mine[row]) & (start + core <= mine[row + 1])
            start = start[fits]
            hashes.append(_text.run_hash(sums, start, start + core))
            places.append(start + c)
            runs += [(x + c, y + c) for x, y in found]
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    places, once = np.unique(places, return_index=True)
    return hashes[once], places, np.array(runs, np.int64).reshape(-1, 2)


def _dealt_out(found: np.ndarray, more: np.ndarray, part: int, buckets: int) -> dict:
    """Ascending hashes of a part, packed by index bucket, with a number beside each."""
    edges = _text.bucket_edges(found, buckets)
    used = np.flatnonzero(np.diff(edges))
    cuts = [slice(edges[b], edges[b + 1]) for b in used]
    return {"bucket": used.tolist(), "part": [part] * len(used), "cores": [_text.pack_sorted(found[c]) for c in cuts], "more": [more[c].tobytes() for c in cuts]}


_INDEX = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("cores", pa.binary()), ("more", pa.binary())])
_INDEX_SQL = "bucket int, part int, cores binary, more binary"
_LOOKED = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary()), ("any_hot", pa.bool_())])
_LOOKED_SQL = "part int, bucket int, n int, shared binary, hot binary, any_hot boolean"


def _index(buckets: int, length: int, gram: int):
    def run(rows: pa.Table) -> pa.Table:
        """The part's distinct cores, and how often it has each."""
        with np.errstate(over="ignore"):
            part = rows.column("part")[0].as_py()
            _, _, data, off = _parts.arranged(rows)
            found, count = np.unique(_cores(data, off, length, gram)[0], return_counts=True)
        return pa.table(_dealt_out(found, np.minimum(count, 65535).astype(np.uint16), part, buckets), schema=_INDEX)

    return run


def _answers(rows: pa.Table, shared: np.ndarray, hot: np.ndarray, sizes: np.ndarray) -> pa.Table:
    cuts = [slice(a, b) for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist())]
    bits = lambda mask: pa.array([np.packbits(mask[c]).tobytes() for c in cuts], pa.binary())
    return pa.table([rows.column("part"), rows.column("bucket"), pa.array(np.diff(sizes), pa.int32()), bits(shared), bits(hot), pa.array([bool(hot[c].any()) for c in cuts])], schema=_LOOKED)


def _look_up(most: int):
    def run(rows: pa.Table) -> pa.Table:
        """For each part of a bucket, bits for each of its cores: whether it occurs again anywhere, and whether it is hot."""
        each = [_text.unpack_sorted(b.as_py()) for b in rows.column("cores")]
        sizes = np.cumsum([0, *map(len, each)])
        count = np.concatenate([np.frombuffer(b.as_py(), np.uint16) for b in rows.column("more")])
        _, back = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(back, weights=count)[back]
        return _answers(rows, total > 1, total > most, sizes)

    return run


def _look_up_windows(rows: pa.Table) -> pa.Table:
    """For each part of a bucket, a bit for each of its windows: whether another part has it."""
    each = [_text.unpack_sorted(b.as_py()) for b in rows.column("cores")]
    sizes = np.cumsum([0, *map(len, each)])
    first, second = np.concatenate(each), np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in rows.column("more")])
    order = np.lexsort((second, first))
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    shared = np.zeros(len(first), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return _answers(rows, shared, np.zeros(len(first), bool), sizes)


def _bits(answers: pa.Table, name: str, n: int) -> np.ndarray:
    """A part's bits in the order of its ascending hashes."""
    if not answers.num_rows:
        return np.zeros(n, bool)
    answers = answers.sort_by("bucket")
    return np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=k.as_py()) for b, k in zip(answers.column(name), answers.column("n"))]).astype(bool)


def _window_keys(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of so many bytes at ascending places, as two hashes of each (ascending by the first), and which of them each place has.

    The second is over mixed eight-byte words instead of bytes.
    """
    one, two = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + LOT_BYTES, side="right"))
        lo = int(at[i])
        piece = data[lo : at[j - 1] + size]
        here = at[i:j] - lo
        one[i:j] = _text.run_hash(_text.prefix_hash(_text.byte_values(piece)), here, here + size)
        eight = np.lib.stride_tricks.sliding_window_view(piece, 8)
        words = np.ascontiguousarray(eight).view("<u8").ravel()
        two[i:j] = _text.run_hash(_text.prefix_hash(_text.mix(words ^ np.uint64(_text.BASE))), here, here + size - 7)
        i = j
    order = np.lexsort((two, one))
    new = np.ones(len(at), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return one[order][new], two[order][new], which


def _around(places: np.ndarray, off: np.ndarray, n: int, length: int, half: int) -> np.ndarray:
    """Starts of the windows around cores."""
    row = np.searchsorted(off, places, side="right") - 1
    lo, hi = np.maximum(off[row], places - half), np.minimum(places, off[row + 1] - length)
    some = hi >= lo
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, lo[some], 1)
    np.add.at(step, hi[some] + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1], dtype=np.int32) > 0)


def _hot(buckets: int, length: int, gram: int):
    """Windows around hot cores: their hashes for the index (once a part), and their places for the end (bucket -1)."""
    half = (length - gram) // 2

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not any(answers.column("any_hot").to_pylist()):
            return _INDEX.empty_table()
        part = rows.column("part")[0].as_py()
        with np.errstate(over="ignore"):
            _, _, data, off = _parts.arranged(rows)
            hashes, places, _ = _cores(data, off, length, gram)
            found, back = np.unique(hashes, return_inverse=True)
            at = _around(places[_bits(answers, "hot", len(found))[back]], off, len(data), length, half)
            one, two, _ = _window_keys(data, at, length)
            out = _dealt_out(one, two, part, buckets)
        out["bucket"].append(-1)
        out["part"].append(part)
        out["cores"].append(at.astype(np.int64).tobytes())
        out["more"].append(None)
        return pa.table(out, schema=_INDEX)

    return run


_CONTEXTS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("place", pa.binary()), ("context", pa.binary()), ("runs", pa.binary())])
_CONTEXTS_SQL = "bucket int, part int, place binary, context binary, runs binary"


def _contexts(buckets: int, length: int, gram: int):
    """Contexts of the cores that occur again, by bucket; and the part's periodic stretches (bucket -1).

    A context is half bytes, the core, half bytes, and how many bytes of its document there are to the left and to the right.
    """
    half = (length - gram) // 2
    core = gram + half

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _CONTEXTS.empty_table()
        part = rows.column("part")[0].as_py()
        with np.errstate(over="ignore"):
            _, _, data, off = _parts.arranged(rows)
            hashes, places, runs = _cores(data, off, length, gram)
        out = {name: [] for name in _CONTEXTS.names}

        def add(**cells) -> None:
            for name in out:
                out[name].append(part if name == "part" else cells.get(name))

        if len(runs):
            add(bucket=-1, runs=runs.tobytes())
        found, back = np.unique(hashes, return_inverse=True)
        keep = (_bits(answers, "shared", len(found)) & ~_bits(answers, "hot", len(found)))[back]
        hashes, places = hashes[keep], places[keep]
        if len(hashes):
            row = np.searchsorted(off, places, side="right") - 1
            room = np.stack([np.minimum(places - off[row], half), np.minimum(off[row + 1] - places - core, half)], axis=1).astype("<u2").view(np.uint8)
            edge = np.zeros(half, np.uint8)
            around = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, data, edge]), core + 2 * half)
            target = (hashes >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(target, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
                at = places[mine]
                add(bucket=int(target[mine[0]]), place=at.astype(np.int64).tobytes(), context=np.concatenate([around[at], room[mine]], axis=1).tobytes())
        return pa.table(out, schema=_CONTEXTS)

    return run


def columns(texts: np.ndarray, start: np.ndarray):
    """Classes of equal suffixes of every length of a collection of equally long documents.

    texts: documents by symbols. start: a number for each document; only documents with equal
    ones are compared. The array given after o rounds numbers, in the order of the suffixes, the
    classes of documents whose last o symbols agree. Each round inserts the symbols of one column.
    """
    n, width = texts.shape
    order = np.argsort(start, kind="stable")
    ranked = start[order]
    classes = np.empty(n, np.int32)
    classes[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    yield classes
    for o in range(1, width + 1):
        column = texts[order, width - o]  # the symbols before the suffixes, in the suffixes' order
        pass_ = np.argsort(column, kind="stable")
        order, column = order[pass_], column[pass_]
        mine = classes[order]
        apart = (column[1:] != column[:-1]) | (mine[1:] != mine[:-1])
        classes = np.empty(n, np.int32)
        classes[order] = np.concatenate([[0], np.cumsum(apart)])
        yield classes


def reaches(contexts: np.ndarray, room: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of distinct contexts, the least and the most bytes to the left of its core in a window that another has too (-1: none)."""
    n = len(contexts)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    with tempfile.TemporaryFile() as file:
        core = contexts.shape[1] - 2 * half
        # The core and what is right of it, mirrored: its suffixes are the prefixes from the core on.
        for o, classes in enumerate(columns(np.ascontiguousarray(contexts[:, half:][:, ::-1]), np.zeros(n, np.int32))):
            if o == core:
                same_core = classes
            if o >= core:
                file.write(classes.tobytes())
        for o, lefts in enumerate(columns(contexts[:, :half], same_core)):
            fits = np.flatnonzero((room[:, 0] >= o) & (room[:, 1] >= half - o))
            if len(fits) < 2:
                continue
            file.seek(4 * n * (half - o))
            rights = np.frombuffer(file.read(4 * n), np.int32)
            key = lefts[fits].astype(np.int64) * n + rights[fits]
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            twin = np.zeros(len(fits), bool)
            same = ranked[1:] == ranked[:-1]
            twin[order[1:]] |= same
            twin[order[:-1]] |= same
            found = fits[twin]
            most[found] = o
            least[found[least[found] < 0]] = o
    return least, most


_SPANS = pa.schema([("part", pa.int32()), ("start", pa.binary()), ("end", pa.binary())])


def _match(length: int, gram: int):
    half = (length - gram) // 2
    width = gram + 3 * half + 4

    def run(rows: pa.Table) -> pa.Table:
        # Equal contexts become one document of the collection.
        known: dict[bytes, int] = {}
        which: list[int] = []
        for blob in rows.column("context"):
            blob = blob.as_py()
            which += [known.setdefault(blob[i : i + width], len(known)) for i in range(0, len(blob), width)]
        which = np.array(which, np.int64)
        table = np.frombuffer(b"".join(known), np.uint8).reshape(-1, width)
        n = len(known)
        del known
        room = np.ascontiguousarray(table[:, -4:]).view("<u2").astype(np.int64)
        least, most = reaches(table[:, :-4], room, half)
        # A context that occurs twice has all its windows twice.
        lo, hi = np.maximum(half - room[:, 1], 0), np.minimum(room[:, 0], half)
        again = (np.bincount(which, minlength=n) > 1) & (lo <= hi)
        least[again], most[again] = lo[again], hi[again]
        out = {"part": [], "start": [], "end": []}
        at = 0
        for part, blob in zip(rows.column("part").to_pylist(), rows.column("place")):
            place = np.frombuffer(blob.as_py(), np.int64)
            mine = which[at : at + len(place)]
            at += len(place)
            hit = most[mine] >= 0
            if hit.any():
                out["part"].append(part)
                out["start"].append((place[hit] - most[mine[hit]]).tobytes())
                out["end"].append((place[hit] - least[mine[hit]] + length).tobytes())
        return pa.table(out, schema=_SPANS)

    return run


def _finish(length: int):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        ids, _, data, off = _parts.arranged(rows)
        step = np.zeros(len(data) + 1, np.int32)
        for name, by in (("start", 1), ("end", -1)):
            for blob in told.column(name).drop_null():
                np.add.at(step, np.frombuffer(blob.as_py(), np.int64), by)
        for blob in told.column("runs").drop_null():
            run_ = np.frombuffer(blob.as_py(), np.int64).reshape(-1, 2)
            np.add.at(step, run_[:, 0], 1)
            np.add.at(step, run_[:, 1], -1)
        hot = [np.frombuffer(b.as_py(), np.int64) for b in told.column("places").drop_null()]
        if hot and len(hot[0]):
            with np.errstate(over="ignore"):
                _, _, which = _window_keys(data, hot[0], length)
            count = np.bincount(which)
            again = _bits(told.filter(pc.is_valid(told.column("shared"))), "shared", len(count)) | (count > 1)
            at = hot[0][again[which]]
            np.add.at(step, at, 1)
            np.add.at(step, at + length, -1)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        del step
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = off[:-1][np.diff(off) > 0]
        opens[edge] = gone[edge]
        upto = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])[off]
        flat = data[~gone].tobytes()
        at = upto(~gone)
        texts = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.table({
            "doc_id": ids,
            "n_bytes": pa.array(np.diff(off), pa.int64()),
            "n_removed": pa.array(np.diff(upto(gone)), pa.int64()),
            "n_spans": pa.array(np.diff(upto(opens)), pa.int64()),
            "kept": pa.array(texts, pa.binary()),
        })

    return run


def _digest(inner):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = inner(rows, told)
        sha = [hashlib.sha256(t.as_py()).hexdigest() for t in out.column("kept")]
        return out.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sha, pa.string()))

    return run


def _cleaned(docs: DataFrame, doc_id: str, text: str, length: int, gram: int, finish, schema: str) -> DataFrame:
    dealt, parts, size = _parts.deal(docs, doc_id, text, PART_BYTES)
    anchors = max(1, 2 * size // (length - gram + 2))  # as many as minimal hashes give on average
    buckets = max(1, -(-2 * anchors // BUCKET_CORES))
    context_buckets = max(1, -(-2 * anchors // BUCKET_CONTEXTS))
    dealt = dealt.repartition(_parts.tasks(docs.sparkSession, parts), "part")  # one exchange for all uses
    index = dealt.groupBy("part").applyInArrow(_index(buckets, length, gram), _INDEX_SQL)
    shared = index.groupBy("bucket").applyInArrow(_look_up(HOT), _LOOKED_SQL)
    contexts = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_contexts(context_buckets, length, gram), _CONTEXTS_SQL)
    spans = contexts.where("bucket >= 0").groupBy("bucket").applyInArrow(_match(length, gram), "part int, start binary, end binary")
    runs = contexts.where("bucket < 0").select("part", "runs")
    hot = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_hot(buckets, length, gram), _INDEX_SQL)
    windows = hot.where("bucket >= 0").groupBy("bucket").applyInArrow(_look_up_windows, _LOOKED_SQL)
    places = hot.where("bucket < 0").select("part", F.col("cores").alias("places"))
    told = spans
    for more in (runs, windows.drop("hot", "any_hot"), places):
        told = told.unionByName(more, allowMissingColumns=True)
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(finish, schema)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each row. length - gram is even."""
    return _cleaned(docs, doc_id, text, length, gram, _finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """As cleaned(), with the SHA-256 of the kept bytes in place of them."""
    return _cleaned(docs, doc_id, text, length, gram, _digest(_finish(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT r, k, md5(b[k:k + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS k FROM b)),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hits AS (SELECT r, k FROM windows SEMI JOIN twice USING (h)),
marks AS (SELECT *, coalesce(k - lag(k) OVER (PARTITION BY r ORDER BY k) > 400, true) AS opens FROM hits),
runs AS (SELECT r, min(k) AS a, max(k) + 400 AS z FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM marks) GROUP BY r, g),
cuts AS (SELECT r, sum(z - a)::BIGINT AS n, count(*) AS spans FROM runs GROUP BY r),
keeps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS z FROM (SELECT r, a, z FROM runs UNION ALL SELECT r, octet_length(b) + 1, NULL FROM b)),
kept AS (SELECT r, unhex(string_agg(hex(b[a:z - 1]), '' ORDER BY a)) AS rest FROM keeps JOIN b USING (r) WHERE z > a GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(rest, ''::BLOB)) AS kept_sha256 FROM b LEFT JOIN cuts USING (r) LEFT JOIN kept USING (r)
"""
