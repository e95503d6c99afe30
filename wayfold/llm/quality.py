"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

A text's features are hashed n-grams (one to three) of two word sequences: its words with
A-Z lower-cased (one and two), and the words' shapes, in which runs of one kind of character
become one sign (one to three). A word that repeats its predecessor also gives a sign of its
own, whatever the word. Counts go through log(1 + n) and are scaled to length one, so that
long texts weigh no more than short ones. The weights are trained with follow-the-regularised-
leader updates (per-coordinate rates, L1 and L2), and a score is the sigmoid of the sparse
dot product of features and weights.

Training uses at most TRAIN_ROWS labelled documents, those with the smallest seeded hash of
their id, one text of each (the smallest), until their texts make TRAIN_BYTES; these bounds are
the size of what the one training task holds. Scoring reads every whole text, of any length.
Only the text is an input of a score.

A null or empty text has no features; its score is that of the bias. Rows with a null label or
id are not trained on; of several labels of one document the smallest counts. Without any
label, every score is 0.5. Repeated rows each get their row, with equal scores. Extra columns,
whatever their names, are ignored; accepted() returns them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _parts, _text
from ._tables import table

BITS = 20
TRAIN_ROWS, TRAIN_BYTES = 5000, 64 << 20
#: Passes over the examples: as many as give UPDATES updates, within these bounds.
EPOCHS = (3, 20)
UPDATES = 15_000
SEED = 11
THRESHOLD = 0.7
LOT_BYTES = 1 << 20
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 1.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _kinds() -> np.ndarray:
    """Kinds of bytes: lower, upper, digit, not ASCII; every other byte is its own kind."""
    kind = np.arange(256, dtype=np.uint64) + np.uint64(8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 1
    return kind


_KIND = _kinds()
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1)) for k in range(8)]


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its runs of one kind, without their lengths."""
    kind = _KIND[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[start] = True
    turns = np.concatenate([[0], np.cumsum(turn)])
    sums = _text.prefix_hash(_text.mix(kind[turn]))
    return _text.run_hash(sums, turns[start], turns[end])


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of each distinct feature of a column's rows, by row."""
    start, end, first = _text.words(data, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row = _text.owners(first)
    word = _text.word_hash(_LOWER[data], start, end)
    shape = _shapes(data, start, end)
    one = row[1:] == row[:-1]
    two = one[1:] & one[:-1]
    again = one & (word[1:] == word[:-1])
    pair = lambda a, salt: _text.mix(a[:-1] * _SALT[salt] + a[1:])
    shapes2 = pair(shape, 1)
    rows = [row, row[1:][one], row, row[1:][one], row[2:][two], row[1:][again]]
    hashes = [
        word ^ _SALT[0], pair(word, 2)[one], shape ^ _SALT[3], shapes2[one] ^ _SALT[4],
        _text.mix(shapes2[:-1] * _SALT[5] + shape[2:])[two], np.full(int(again.sum()), _SALT[6]),
    ]
    shift = np.uint64(64 - bits)
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(bits)) | (np.concatenate(hashes) >> shift)
    key.sort()
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(edge)
    value = np.log1p(np.diff(np.concatenate([at, [len(key)]])).astype(np.float64))
    key = key[at]
    row = (key >> np.uint64(bits)).astype(np.int64)
    length = np.sqrt(np.bincount(row, value * value, len(off) - 1))
    return row, (key & np.uint64((1 << bits) - 1)).astype(np.int64), value / length[row]


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (slots, values, label): the weights and the bias."""
    size = (1 << bits) + 1  # the last slot is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(SEED)
    for _ in range(min(EPOCHS[1], max(EPOCHS[0], -(-UPDATES // max(1, len(examples)))))):
        for i in order.permutation(len(examples)):
            slots, values, label = examples[i]
            slots, values = np.append(slots, size - 1), np.append(values, 0.1)
            zs, ns = z[slots], n[slots]
            w = weights(zs, ns)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values
            z[slots] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[slots] = ns + g * g
    w = weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1] * 0.1)


def _train_rows(rows: pa.Table) -> pa.Table:
    """The one training task: at most TRAIN_ROWS labelled texts in, one model out."""
    rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    labels = rows.column("label").to_pylist()
    data, off = _text.column_bytes(rows.column("text").cast(pa.large_string()))
    examples = []
    with np.errstate(over="ignore"):
        for a, b in _parts.lots(off, LOT_BYTES):
            row, slot, value = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            examples += [(slot[x:y].astype(np.int32), value[x:y].astype(np.float32), labels[a + k]) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:]))]
    w, bias = train(examples)
    return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias])})


def model(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled documents (at most TRAIN_ROWS ids, one text of each, until they make TRAIN_BYTES)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    few = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(TRAIN_ROWS)
    thin = docs.select("doc_id", "text")
    # At most TRAIN_ROWS pairs of numbers are broadcast; no text is shuffled but theirs.
    rows = thin.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").cast("int").alias("label"))
    # In the order in which they were chosen, so many as make TRAIN_BYTES (the first in any case).
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < TRAIN_BYTES).drop("before")
    one = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_train_rows, "weights binary, bias double").first()
    if one is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(one["weights"], np.float32), one["bias"]


def _scorer(sent, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        with np.errstate(over="ignore"):
            for batch in batches:
                data, off = _text.column_bytes(batch.column(1))
                for a, b in _parts.lots(off, LOT_BYTES):
                    row, slot, value = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    dot = np.bincount(row, value * w[slot], b - a) + bias
                    score = 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB whatever the data
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(sent, bias), "doc_id long, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model from the labels that are not held out."""
    return model(docs, labels.where(~held_out()))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = scored(docs, *trained(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    weights, bias = trained(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")
    logit = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        with np.errstate(over="ignore"):
            for batch in batches:
                data, off = _text.column_bytes(batch.column(at))
                for a, b in _parts.lots(off, LOT_BYTES):
                    row, slot, value = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    good = np.bincount(row, value * w[slot], b - a) + bias >= logit
                    yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
