"""SentencePiece BPE encoding by backtracking, and decoding.

The encoder works on one word at a time: no piece of the model has a space mark after another
character, so no merge crosses the start of a run of space marks, and a text's ids are those
of its words in order. A word is encoded by taking the longest piece at each position (found
by an Aho-Corasick automaton), accepting it only if re-merging it with its predecessor leaves
both as they are, else trying the next shorter one; positions from which no encoding exists
are marked in a bitfield, so each is tried once. Accepted neighbours are compatible, and such
an encoding is the one that merging by rank gives. Runs of space marks are all merged at one
rank, where only the order of places decides; words that hold more than one are therefore
merged directly. Characters without a piece become their UTF-8 bytes' pieces.

Words come back often; a worker keeps the ids of a bounded number of them. Words longer than
LONG characters are encoded but not kept.

A null text is empty and has no ids. Texts of any length are encoded whole. Repeated rows each
get their row, with equal ids. Extra columns, whatever their names, are ignored; with_ids()
returns them, but for columns named n_tokens or ids, which it writes. An empty table gives an
empty result. The model is a file of the public tokenizers, read once by the driver; its bytes are
sent to the workers (its size is that of the vocabulary, not of the data).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import spread, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words kept by a worker, in two halves: when the new half is full, the old one goes.
KEPT = 1_200_000
#: Verdicts on neighbouring pieces kept by a worker.
PAIRS = 600_000
LONG = 64
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """Encoder and decoder for one model."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id: dict[int, int] = {}
        self.rank: dict[str, tuple[float, int]] = {}
        self.special: set[int] = set()
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.special.add(i)
            else:
                self.rank[piece] = (sp.get_score(i), i)
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = sp.unk_id()
        self.auto = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            self.auto.add_word(piece, i)
        self.auto.make_automaton()
        self.chars = {piece for piece in self.rank if len(piece) == 1}
        self.size_of = [len(piece) for piece in self.pieces]
        #: The longest other piece that a piece starts with, or -1.
        self.shorter = [next((self.rank[p[:k]][1] for k in range(len(p) - 1, 0, -1) if p[:k] in self.rank), -1) if p in self.rank else -1 for p in self.pieces]
        self.spoken = [piece.replace(MARK, " ") for piece in self.pieces]
        self.shown = [str(i) for i in range(len(self.pieces))]
        self.agree: dict[int, bool] = {}
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def merge(self, word: str) -> list[str]:
        """Merging by rank: the best-scored adjacent pair first, the leftmost of equal ones."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.rank.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text again gives the same two pieces."""
        if len(self.agree) > PAIRS:
            self.agree.clear()
        pair = [self.pieces[left], self.pieces[right]]
        found = self.agree[left << 20 | right] = self.merge(pair[0] + pair[1]) == pair
        return found

    def backtrack(self, word: str) -> list[int] | None:
        """The ids of a word all of whose characters have pieces; None if there is no encoding."""
        n = len(word)
        longest = [-1] * (n + 1)  # the longest piece that starts at each position
        size_of, shorter, agree = self.size_of, self.shorter, self.agree
        for end, i in self.auto.iter(word):
            longest[end + 1 - size_of[i]] = i  # ends ascend, so a longer piece comes later
        failed = 0  # a bit for each position from which no encoding exists
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            before = out[-1] if out else -1
            while token >= 0:
                end = pos + size_of[token]
                if not failed >> end & 1:
                    if before < 0:
                        break
                    fits = agree.get(before << 20 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos]
            else:
                failed |= 1 << pos
                if not out:
                    return None
                token = out.pop()
                pos -= size_of[token]
                token = shorter[token]
        return out

    def ids(self, word: str) -> list[int]:
        """The ids of one word (its space marks included)."""
        if word.rfind(MARK) <= 0 and self.chars.issuperset(word):
            found = self.backtrack(word)
            if found is not None:
                return found
        if word.count(MARK) > 1:
            parts = self.merge_fast(word)
            return [i for part in parts for i in self.piece_ids(part)]
        out: list[int] = []
        run: list[str] = []
        for ch in [*word, ""]:
            if ch in self.rank:
                run.append(ch)
                continue
            if run:
                whole = "".join(run)
                found = self.backtrack(whole)
                out += [i for part in self.merge_fast(whole) for i in self.piece_ids(part)] if found is None else found
                run = []
            out += self.piece_ids(ch)
        return out

    def piece_ids(self, part: str) -> list[int]:
        found = self.rank.get(part)
        if found is not None:
            return [found[1]]
        return [self.byte_id[b] for b in part.encode("utf-8")] if self.byte_id else [self.unknown] * bool(part)

    def merge_fast(self, word: str) -> list[str]:
        """merge() by a queue, for words of any length."""
        import heapq

        n = len(word)
        text: list[str | None] = list(word)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n:
                both = text[i] + text[j]
                found = self.rank.get(both)
                if found is not None:
                    heapq.heappush(queue, (-found[0], i, j, both))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if text[i] is None or text[j] is None or nxt[i] != j or text[i] + text[j] != both:
                continue
            text[i], text[j] = both, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [t for t in text if t is not None]

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, as the library's decode: bytes joined, marks to spaces, one leading space off."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.special:
                out.append(self.pieces[i].replace(MARK, " "))
            elif i == self.unknown:
                out.append(" ⁇ ")
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if ids and self.pieces[ids[0]].startswith(MARK) else text

    def text_of(self, ids: list[int]) -> str:
        """decode_ids with the leading space left on, as a word's ids stand inside a text."""
        text = self.decode_ids(ids)
        return " " + text if ids and self.pieces[ids[0]].startswith(MARK) else text

    def keep(self, part: str) -> str:
        """The ids, as decimals joined by commas, of a word that follows one space."""
        found = self.old.get(part)
        if found is None:
            ids = self.ids(MARK + part)
            shown, spoken = self.shown, self.spoken
            found = ",".join([shown[i] for i in ids])
            if "".join([spoken[i] for i in ids]) != " " + part and (back := self.text_of(ids)) != " " + part:
                if len(self.odd) > KEPT:
                    self.odd.clear()
                    self.new.clear()
                    self.old.clear()
                self.odd[part] = back
        if len(part) <= LONG:
            if len(self.new) >= KEPT // 2:
                self.old, self.new = self.new, {}
            self.new[part] = found
        return found

    def encode(self, text: str) -> tuple[str, str]:
        """A text's ids as decimals joined by commas, and the text they decode to."""
        if not text:
            return "", ""
        parts = text.split(" ")
        if MARK in text or "" in parts:
            ids = [i for word in _WORD.findall(MARK + text.replace(" ", MARK)) for i in (map(int, self.keep(word[1:]).split(",")) if word[0] == MARK and MARK not in word[1:] else self.ids(word))]
            return ",".join(map(str, ids)), self.decode_ids(ids)
        get = self.new.get
        joined = ",".join([get(part) or self.keep(part) for part in parts])
        # Each word was decoded when it was first met; words that don't come back as they were are odd.
        if self.odd and not self.odd.keys().isdisjoint(parts):
            return joined, self.decode_ids(list(map(int, joined.split(","))))
        return joined, text


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """This process's codec for a model."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _encoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(model.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids, decoded = mine.encode(value.as_py() or "")
                count.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(sha(ids))
                text_sha.append(sha(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return thin.mapInArrow(_encoder(sent), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with n_tokens and ids (array of int) in place of the text, and of columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    rest = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]
    thin = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(sent.value)
        for batch in batches:
            made = [np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32) for ids in (mine.encode(v.as_py() or "")[0] for v in batch.column(batch.num_columns - 1))]
            count = np.array([len(m) for m in made], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *made])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count), ids], [*rest, "n_tokens", "ids"])

    out = T.StructType([*thin.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return thin.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spread(table(spark, sf_dir, "documents")))
