"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The documents are dealt into reference blocks of bounded size. Every block is indexed: the
hashes of its word windows (FACTOR consecutive words of one document), sorted, each with its
first document, dealt by range of the hash to index buckets. A bucket tells each block which of
its windows a document with a smaller id has, in whichever block, and names that source: the
block and the document with the smallest id of all.

Each document is then parsed relative to the reference blocks: a factor begins at the first
window that a source has and is extended greedily, window by window, while the same source
document has the next. Where a factor ends, the windows across its boundary have been looked up
as well, and the next factor begins at the first of them that any source has, so that none that
straddles two factors is lost. Every factor is claimed from its source block, which finds the
place where its first window occurs in the source document and compares the factor's words, by
a cryptographic digest of all of them. What a source can't show as one stretch (its windows may
lie in other order there) is claimed again window by window. Only windows whose words were found
in their source count. A factor of FACTOR words or more is a duplicate span; its words go.

A block sends each distinct window once and gets one bit for it and, for the few that are
repeated, their source; equal claims of all blocks are one. So a passage that a third of all
documents share costs a few rows a block. No list of blocks or documents is collected.

A null text has no words. A null id counts as larger than all others. Rows with one id are one
document to each other: neither removes the other's words. Texts under FACTOR words keep all;
texts of any length are parsed whole. Extra columns, whatever their names, are ignored. An empty
table gives an empty result. Hashes of 64 bits choose what is claimed; should two different
windows share one, the words decide against the source that was named.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _parts, _text
from ._tables import table

FACTOR = 13
#: Bytes of text in a reference block, and windows in an index bucket, about.
BLOCK_BYTES = 5 << 20
BUCKET_WINDOWS = 3_000_000


def _windows(data: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of every window."""
    count = np.maximum(np.diff(first) - factor + 1, 0)
    place = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    word = np.arange(place[-1]) - place[row] + first[row]
    sums = _text.prefix_hash(_text.word_hash(data, start, end))
    return _text.run_hash(sums, word, word + factor), word, row


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def kept_texts(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Each row's kept words joined by single spaces."""
    flat = data.copy()
    step = np.zeros(len(data) + 1, np.int32)
    step[start[keep]] += 1
    step[end[keep]] -= 1
    mask = np.cumsum(step[:-1]) > 0
    # Before each kept word but a row's first, the byte before it becomes the space.
    kept = np.flatnonzero(keep)
    row = _text.owners(first)[kept]
    later = np.ones(len(kept), bool)
    if len(kept):
        later[0] = False
        later[1:] = row[1:] == row[:-1]
    gaps = start[kept[later]] - 1
    flat[gaps] = 32
    mask[gaps] = True
    size = np.concatenate([[0], np.cumsum(mask)])
    out = flat[mask].tobytes()
    at = size[off]
    return [out[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class _Block:
    """A block's rows (or some of them) in order of their ids, with their words and, unless told otherwise, windows."""

    def __init__(self, rows: pa.Table, factor: int, only=None, windows: bool = True):
        self.part = rows.column("part")[0].as_py() if rows.num_rows else -1
        self.factor = factor
        self.ids, self.order, self.data, self.off = _parts.arranged(rows, only)
        with np.errstate(over="ignore"):
            self.start, self.end, self.first = _text.words(self.data, self.off)
            if windows:
                self.hashes, self.word, self.row = _windows(self.data, self.first, self.start, self.end, factor)
        self._flat: tuple[bytes, np.ndarray] | None = None

    def words_digest(self, word: int, many: int) -> bytes:
        """Of so many words from one on, joined by single spaces."""
        if self._flat is None:
            size = self.end - self.start
            flat = np.full(int(size.sum()) + len(size), 32, np.uint8)
            ink = self.data[~_text.WHITE[self.data]]
            flat[np.arange(len(ink)) + np.repeat(np.arange(len(size)), size)] = ink
            self._flat = flat.tobytes(), np.concatenate([[0], np.cumsum(size + 1)])
        text, at = self._flat
        return hashlib.blake2b(text[at[word] : at[word + many] - 1], digest_size=16).digest()

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ids, ascending, and the place of each row's id among them."""
        return np.unique(self.order, return_inverse=True)

    def factors(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Greedy factors: the first window and how many, and the source's block and document rank."""
        found, at, back = np.unique(self.hashes, return_index=True, return_inverse=True)
        own = self.ranks()[1][self.row]
        seen, source, rank = np.zeros(len(found), bool), np.full(len(found), self.part), own[at]
        if answers.num_rows:
            answers = answers.sort_by("bucket")
            seen = np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for b, n in zip(answers.column("seen"), answers.column("n"))]).astype(bool)
            source[seen], rank[seen] = (np.concatenate([_narrow(b.as_py()) for b in answers.column(n)]) for n in ("source", "rank"))
        # Rows are in order of their ids and np.unique gives the first, so the block's own first document is known too.
        hit = seen[back] | (rank[back] < own)
        source, rank = source[back], rank[back]
        goes_on = np.zeros(len(hit), bool)
        goes_on[1:] = hit[1:] & hit[:-1] & (self.row[1:] == self.row[:-1]) & (source[1:] == source[:-1]) & (rank[1:] == rank[:-1])
        begin = np.flatnonzero(hit & ~goes_on)
        stop = np.flatnonzero(hit & ~np.append(goes_on[1:], False)) + 1
        return begin, stop - begin, source[begin], rank[begin]

    def claimed(self, begin: np.ndarray, many: np.ndarray, source: np.ndarray, rank: np.ndarray, row: np.ndarray) -> pa.Table:
        """Claims of stretches of so many windows from given ones on; row: the rows' places in the whole block."""
        word = self.word[begin]
        digest = [self.words_digest(w, n + self.factor - 1) for w, n in zip(word.tolist(), many.tolist())]
        return pa.table([pa.array(source, pa.int32()), pa.array(rank, pa.int32()), pa.array(self.hashes[begin].view(np.int64)), pa.array(many, pa.int32()), pa.array(digest, pa.binary()),
                         pa.array(np.full(len(begin), self.part), pa.int32()), pa.array(row, pa.int32()), pa.array(word - self.first[self.row[begin]], pa.int32())], schema=_CLAIMS)


def _wide(values: np.ndarray) -> bytes:
    """Numbers from zero on, in as few bytes each as the largest takes."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _narrow(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _index(buckets: int, factor: int):
    def run(rows: pa.Table) -> pa.Table:
        """One row for each bucket that the block has windows for: their hashes, packed, and the first document of each."""
        b = _Block(rows, factor)
        found, at = np.unique(b.hashes, return_index=True)
        known, rank = b.ranks()
        rank = rank[b.row[at]].astype(np.uint16 if len(known) <= 65536 else np.uint32)
        edges = _text.bucket_edges(found, buckets)
        used = np.flatnonzero(np.diff(edges))
        cuts = [slice(edges[k], edges[k + 1]) for k in used]
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "part": pa.array([b.part] * len(used), pa.int32()),
            "windows": pa.array([_text.pack_sorted(found[c]) for c in cuts], pa.binary()), "ranks": pa.array([rank[c].tobytes() for c in cuts], pa.binary()), "ids": pa.array([known.tobytes()] * len(used), pa.binary()),
        })

    return run


def _look_up(rows: pa.Table) -> pa.Table:
    """For each block of a bucket, a bit for each of its windows: whether a document of another block has it, with a smaller id than any of its own; and the block and rank of that with the smallest."""
    each, first, ranks = [], [], []
    for windows, rank, ids in zip(rows.column("windows"), rows.column("ranks"), rows.column("ids")):
        ids = np.frombuffer(ids.as_py(), np.int64)
        each.append(_text.unpack_sorted(windows.as_py()))
        ranks.append(np.frombuffer(rank.as_py(), np.uint16 if len(ids) <= 65536 else np.uint32).astype(np.int32))
        first.append(ids[ranks[-1]])
    sizes = np.cumsum([0, *map(len, each)])
    values, first, ranks = np.concatenate(each), np.concatenate(first), np.concatenate(ranks)
    del each
    owner = np.repeat(rows.column("part").to_numpy().astype(np.int32), np.diff(sizes))
    order = np.argsort(values, kind="stable")
    opens = np.concatenate([[True], values[order][1:] != values[order][:-1]])
    group = np.cumsum(opens) - 1
    first = first[order]
    least = np.minimum.reduceat(first, np.flatnonzero(opens))
    holds = np.flatnonzero(first == least[group])[::-1]
    best = np.empty(len(least), np.int64)
    best[group[holds]] = order[holds]  # of equal ids that of the first block
    seen, at = np.zeros(len(values), bool), np.empty(len(values), np.int64)
    seen[order], at[order] = least[group] < first, best[group]
    cuts = [slice(a, b) for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist())]
    named = [at[c][seen[c]] for c in cuts]
    return pa.table({
        "part": rows.column("part"), "bucket": rows.column("bucket"), "n": pa.array(np.diff(sizes), pa.int32()), "seen": pa.array([np.packbits(seen[c]).tobytes() for c in cuts], pa.binary()),
        "source": pa.array([_wide(owner[n]) for n in named], pa.binary()), "rank": pa.array([_wide(ranks[n]) for n in named], pa.binary()),
    })


_ANSWERS_SQL = "part int, bucket int, n int, seen binary, source binary, rank binary"
_CLAIMS = pa.schema([("source", pa.int32()), ("rank", pa.int32()), ("h", pa.int64()), ("many", pa.int32()), ("digest", pa.binary()), ("part", pa.int32()), ("row", pa.int32()), ("start", pa.int32())])
_CLAIMS_SQL = "source int, rank int, h long, many int, digest binary, part int, row int, start int"
_KEYS = ("source", "rank", "h", "many", "digest")


def _factored(factor: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """What a block claims of its sources: its factors."""
        if not rows.num_rows:
            return _CLAIMS.empty_table()
        b = _Block(rows, factor)
        begin, many, source, rank = b.factors(answers)
        return b.claimed(begin, many, source, rank, b.row[begin])

    return run


def _again(factor: int):
    def run(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        """What a block claims again, window by window: the factors that weren't found as they are."""
        lost = verdicts.filter(pc.equal(verdicts.column("at"), -1))
        if not lost.num_rows:
            return _CLAIMS.empty_table()
        row, start, many, source, rank = (lost.column(n).to_numpy().astype(np.int64) for n in ("row", "start", "many", "source", "rank"))
        places = np.unique(row)
        b = _Block(rows, factor, lambda order: np.isin(np.arange(len(order)), places))
        # A row's windows are in order, one for each word that begins one.
        mine = np.searchsorted(places, row)
        begin = np.searchsorted(b.word, b.first[mine] + start)
        each = np.repeat(np.arange(len(row)), many)
        window = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        return b.claimed(window, np.ones(len(each), np.int64), source[each], rank[each], row[each])

    return run


#: Places of a claim's first window in the source document that are tried; a claim found at none of them is made again window by window.
TRIED = 16
_VERIFIED_SQL = "source int, rank int, h long, many int, digest binary, at long, source_id long"


def _verify(factor: int):
    def run(rows: pa.Table, claims: pa.Table) -> pa.Table:
        """Where the claimed words stand in their source document (-1: nowhere)."""
        at, ids = [], []
        if claims.num_rows:
            known: list[np.ndarray] = []
            wanted = np.unique(claims.column("rank").to_numpy())

            def only(order: np.ndarray) -> np.ndarray:
                ids_, rank_ = np.unique(order, return_inverse=True)
                known.append(ids_)
                return np.isin(rank_, wanted)

            b = _Block(rows, factor, only)
            rank_of = np.searchsorted(known[0], b.order)
            order = np.argsort(b.hashes, kind="stable")
            ranked = b.hashes[order]
            h = claims.column("h").to_numpy().view(np.uint64)
            low, high = np.searchsorted(ranked, h, side="left").tolist(), np.searchsorted(ranked, h, side="right").tolist()
            for x, y, rank, many, digest in zip(low, high, claims.column("rank").to_pylist(), claims.column("many").to_pylist(), claims.column("digest").to_pylist()):
                places = order[x:y]
                row = b.row[places]
                fits = (rank_of[row] == rank) & (b.word[places] + many + factor - 1 <= b.first[row + 1])
                found = next((k for k in places[fits][:TRIED].tolist() if b.words_digest(int(b.word[k]), many + factor - 1) == digest), None)
                at.append(-1 if found is None else int(b.word[found] - b.first[b.row[found]]))
                ids.append(int(known[0][rank]))
        return pa.table([*[claims.column(n) for n in _KEYS], pa.array(at, pa.int64()), pa.array(ids, pa.int64())], names=[*_KEYS, "at", "source_id"])

    return run


def _found(b: _Block, verdicts: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """First word and number of words of the duplicate spans, and their verdicts."""
    mine = verdicts.filter(pc.greater_equal(verdicts.column("at"), 0))
    row, start, many = (mine.column(n).to_numpy().astype(np.int64) for n in ("row", "start", "many"))
    return b.first[row] + start, many + b.factor - 1, mine


def _finish(factor: int):
    def run(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        b = _Block(rows, factor, windows=False)
        starts, size, _ = _found(b, verdicts)
        keep = ~_covered(len(b.start), starts, starts + size) if len(b.start) else np.zeros(0, bool)
        gone = np.concatenate([[0], np.cumsum(~keep)])
        texts = kept_texts(b.data, b.off, b.start, b.end, b.first, keep)
        return pa.table({
            "doc_id": b.ids,
            "n_words": pa.array(np.diff(b.first), pa.int64()),
            "n_removed": pa.array(np.diff(gone[b.first]), pa.int64()),
            "kept": pa.array(texts, pa.large_binary()).cast(pa.binary()),
        })

    return run


def _digest(inner):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = inner(rows, told)
        sha = [hashlib.sha256(t.as_py()).hexdigest() for t in out.column("kept")]
        return out.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sha, pa.string()))

    return run


def _spans(factor: int):
    def run(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        b = _Block(rows, factor, windows=False)
        starts, size, mine = _found(b, verdicts)
        sources = mine.column("source_id").to_numpy()
        return pa.table({
            "doc_id": b.ids.take(mine.column("row")), "start": mine.column("start").cast(pa.int64()), "n_words": pa.array(size, pa.int64()),
            "source_id": pa.array(sources, pa.int64(), mask=sources == _parts.LAST), "source_start": mine.column("at"),
        })

    return run


def _parsed(docs: DataFrame, doc_id: str, text: str, factor: int, finish, schema: str) -> DataFrame:
    dealt, parts, size = _parts.deal(docs, doc_id, text, BLOCK_BYTES)
    buckets = max(1, -(-size // (6 * BUCKET_WINDOWS)))
    tasks = _parts.tasks(docs.sparkSession, parts)
    # All uses of the dealt texts share one exchange.
    dealt = dealt.repartition(tasks, "part")
    blocks = dealt.groupBy("part")
    index = blocks.applyInArrow(_index(buckets, factor), "bucket int, part int, windows binary, ranks binary, ids binary")
    answers = index.groupBy("bucket").applyInArrow(_look_up, "part int, bucket int, n int, seen binary, source binary, rank binary")

    def verdicts(claims: DataFrame) -> DataFrame:
        """The claims with the place that each was found at. Equal claims of all blocks are verified once."""
        claims = claims.repartition(tasks, "source")
        # With all columns, so that both uses of the claims share one exchange.
        asked = claims.groupBy(*_KEYS).agg(F.min(F.struct("part", "row", "start")).alias("first")).where("first IS NOT NULL").select(*_KEYS)
        verified = blocks.cogroup(asked.groupBy("source")).applyInArrow(_verify(factor), _VERIFIED_SQL)
        return claims.join(verified, list(_KEYS)).drop("digest", "h").repartition(tasks, "part")

    one = verdicts(blocks.cogroup(answers.groupBy("part")).applyInArrow(_factored(factor), _CLAIMS_SQL))
    two = verdicts(blocks.cogroup(one.groupBy("part")).applyInArrow(_again(factor), _CLAIMS_SQL))
    return blocks.cogroup(one.unionByName(two).groupBy("part")).applyInArrow(finish, schema)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", factor: int = FACTOR) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (binary, joined by spaces) of each row."""
    return _parsed(docs, doc_id, text, factor, _finish(factor), "doc_id long, n_words long, n_removed long, kept binary")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", factor: int = FACTOR) -> DataFrame:
    """As deduplicated(), with the SHA-256 of the kept words in place of them."""
    return _parsed(docs, doc_id, text, factor, _digest(_finish(factor)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", factor: int = FACTOR) -> DataFrame:
    """The factors: doc_id, first word and number of words, and the document and word that they are copied from."""
    return _parsed(docs, doc_id, text, factor, _spans(factor), "doc_id long, start long, n_words long, source_id long, source_start long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, doc_id, k, array_to_string(ws[k:k + 12], ' ') AS key FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w)),
firsts AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
gone AS (SELECT DISTINCT r, k + o AS pos FROM (SELECT r, k FROM windows JOIN firsts USING (key) WHERE first < doc_id), range(13) AS t(o)),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""
