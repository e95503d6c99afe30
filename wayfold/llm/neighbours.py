"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each of BOOKS codebooks.
The books are trained one after another on the residuals of a bounded sample and the codes are
found by beam search: of the partial sums that WIDTH candidates make with every codeword of
the next book, the WIDTH closest to the vector go on. A vector is stored as BOOKS bytes and the
norm of its sum. A query's inner products with all codewords form a table, so the inner product
with any stored sum is BOOKS lookups; the stored norm turns it into a squared distance where
that is the measure. The RERANK best of each block of vectors are scored again on the original
vectors in double precision. A vector far longer than any of the sample is scored on itself.

Every row that takes part is coded and indexed, in the cell of its nearest centre (about one
cell for CELL_ROWS rows, at most CELLS). A query visits the cells nearest to it. How many is
measured in training: so many that, of the true neighbours of queries within the sample, RECALL
lie in the visited cells. Vectors without any structure need about half of all cells, clustered
ones few; cells=1 scans everything. A cell of more than BLOCK_ROWS vectors, and its queries, are
split into blocks; each block of queries visits each block of its cell once, and gives at most
k rows a query, of which the best k are the answer. Equal vectors of a block are coded and
scored as one, which stands for its k + 1 smallest ids (more can't be among the k nearest), so
copies don't take the places of others. Nothing is all held in one place.

Vectors that are null, empty, zero, of another dimension than most in the sample, or that hold
a null or a component that is not finite take no part, neither do rows with a null id. Repeated
rows are candidates each; a query's own id is none of its candidates; a query id that is
repeated is searched once for each distinct vector it has, the best k of all its answers
counting. Ties go to the smaller id. Extra columns, whatever their names, are ignored. An empty
table gives an empty result. Components may be floats or doubles; scores are of the originals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import table

BOOKS, WORDS, WIDTH = 16, 256, 4
#: Vectors that the codebooks are trained on, at most: those with the smallest hash of their id.
SAMPLE = 8000
#: Candidates of a block that are scored exactly, and vectors and queries in a block.
RERANK = 400
BLOCK_ROWS, BLOCK_QUERIES = 16384, 512
#: Rows to a cell, about; cells at most; the share of neighbours to be in the visited cells, and queries that measure it.
CELL_ROWS, CELLS, RECALL, MEASURED = 4096, 1024, 0.97, 400
ROUNDS = 8
SEED = 5


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        used = count > 0
        sums = np.zeros_like(centres)
        sums[used] = np.add.reduceat(x[np.argsort(near, kind="stable")], (np.cumsum(count) - count)[used])
        centres[used] = sums[used] / count[used, None]
    return centres


def _extend(x: np.ndarray, sums: np.ndarray, codes: np.ndarray, book: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One step of the beam search: the best width sums (rows by beam) with a codeword of the next book, and their codes."""
    rest = x[:, None, :] - sums
    # Distance to the vector after adding each codeword, but for a constant.
    cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
    flat = cost.reshape(len(x), -1)
    keep = min(width, flat.shape[1])
    best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
    beam, word = best // len(book), best % len(book)
    rows = np.arange(len(x))[:, None]
    return sums[rows, beam] + book[word], np.concatenate([codes[rows, beam], word[:, :, None].astype(np.uint8)], axis=2)


def _best_beam(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    rest = x[:, None, :] - sums
    return np.argmin((rest * rest).sum(2), axis=1)


def encode(x: np.ndarray, books: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows by books) and the squared norms of their sums, by beam search."""
    n = len(x)
    sums, codes = np.zeros((n, 1, x.shape[1]), np.float32), np.zeros((n, 1, 0), np.uint8)
    for book in books:
        sums, codes = _extend(x, sums, codes, book, width)
    rows, best = np.arange(n), _best_beam(x, sums)
    final = sums[rows, best]
    return codes[rows, best], (final * final).sum(1)


def train(x: np.ndarray) -> np.ndarray:
    """Codebooks (books, words, dimensions) from a sample, each on the residuals of those before it."""
    rng = np.random.default_rng(SEED)
    x = x.astype(np.float32)
    books = np.zeros((BOOKS, WORDS, x.shape[1]), np.float32)
    lots = [slice(a, a + 1024) for a in range(0, len(x), 1024)]
    state = [(np.zeros((len(x[lot]), 1, x.shape[1]), np.float32), np.zeros((len(x[lot]), 1, 0), np.uint8)) for lot in lots]
    for b in range(BOOKS):
        rest = np.concatenate([x[lot] - sums[np.arange(len(sums)), _best_beam(x[lot], sums)] for lot, (sums, _) in zip(lots, state)])
        books[b] = _kmeans(rest, WORDS, rng)
        state = [_extend(x[lot], *beams, books[b], WIDTH) for lot, beams in zip(lots, state)]
    return books


def nearness(x: np.ndarray, to: np.ndarray, measure: str) -> np.ndarray:
    """Rows of x by rows of to: the larger, the nearer."""
    dot = x @ to.T
    return dot if measure == "product" else 2 * dot - (to * to).sum(1)


def cells_to_visit(x: np.ndarray, centres: np.ndarray, k: int, measure: str) -> int:
    """The least number of cells that hold RECALL of the k nearest, for queries and neighbours of the sample."""
    asked = x[np.random.default_rng(SEED).permutation(len(x))[:MEASURED]]
    near = nearness(asked, x, measure)
    k = min(k + 1, len(x))  # one is the query itself
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-nearness(asked, centres, measure), axis=1), axis=1)
    found = np.take_along_axis(place, nearest(x, centres)[top], axis=1)
    shares = np.cumsum(np.bincount(found.ravel(), minlength=len(centres))) / found.size
    return int(np.searchsorted(shares, RECALL)) + 1


def _train_rows(cells: int, k: int, measure: str):
    def run(rows: pa.Table) -> pa.Table:
        """The one training task: at most SAMPLE vectors in, the codebooks and centres out."""
        vectors = [np.array(v, np.float64) for v in rows.sort_by("vec_id").column("v").to_pylist()]
        sizes = np.bincount([len(v) for v in vectors])
        x = _small(np.stack([v for v in vectors if len(v) == sizes.argmax()]))
        centres = _kmeans(x, min(cells, len(x)), np.random.default_rng(SEED))
        longest = float((x.astype(np.float64) ** 2).sum(1).max())
        return pa.table({
            "books": pa.array([train(x).tobytes()], pa.binary()), "size": pa.array([x.shape[1]], pa.int32()), "centres": pa.array([centres.tobytes()], pa.binary()),
            "probes": pa.array([cells_to_visit(x, centres, k, measure)], pa.int32()), "longest": pa.array([longest]),
        })

    return run


def _small(x: np.ndarray) -> np.ndarray:
    """As float32, for codes and centres only; components beyond its range are cut there."""
    return np.clip(x, -1e15, 1e15).astype(np.float32)


def _pack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components (rows by dimensions) of a group, by id."""
    rows = rows.combine_chunks().sort_by("vec_id")
    vectors = rows.column("v").combine_chunks()
    return rows.column("vec_id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _to_cells(sent, probes: int | None, measure: str):
    """cell, vec_id, v: each vector with the cell of its nearest centre or, given probes, once for each of so many nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, centres, _ = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _small(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            cell = nearest(x, centres)[:, None] if probes is None else np.argsort(-nearness(x, centres, measure), axis=1, kind="stable")[:, :probes]
            for column in cell.T:
                yield pa.RecordBatch.from_arrays([pa.array(column.astype(np.int32)), *batch.columns], ["cell", "vec_id", "v"])

    return run


def _query_block(rows: pa.Table) -> pa.Table:
    cell = rows.column("cell")[0].as_py()
    ids, x = _pack(rows)
    return pa.table({"cell": pa.array([cell], pa.int32()), "queries": pa.array([ids.tobytes()], pa.binary()), "wanted": pa.array([x.tobytes()], pa.binary())})


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id; best first."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _coded(sent, k: int):
    """A block of different vectors with their codes, norms and smallest ids."""

    def run(rows: pa.Table) -> pa.Table:
        cell, block = rows.column("cell")[0].as_py(), rows.column("block")[0].as_py()
        ids, x = _pack(rows)
        x = np.ascontiguousarray(x)
        _, first, which, count = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")  # by vector, and by id as before
        start = np.cumsum(count) - count
        order = order[np.arange(len(x)) - np.repeat(start, count) <= k]
        ids, owner, x = ids[order], which[order], x[first]
        books, _, longest = sent.value
        made = [encode(_small(x[a : a + 1024]), books) for a in range(0, len(x), 1024)]
        norms = np.concatenate([m for _, m in made])
        with np.errstate(over="ignore"):
            norms[(x.astype(np.float64) ** 2).sum(1) > 4 * longest] = np.nan  # beyond what the books can say
        cells = {"ids": ids, "starts": np.searchsorted(owner, np.arange(len(x) + 1)), "vectors": x, "codes": np.concatenate([c for c, _ in made]), "norms": norms}
        return pa.table({"cell": pa.array([cell], pa.int32()), "block": pa.array([block], pa.int64())} | {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in cells.items()})

    return run


def _visit(sent, kind: str, size: int, k: int, rerank: int, measure: str):
    """Answers of the query blocks that came to a block of vectors."""

    def scores(x: np.ndarray, vector: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return x @ vector if measure == "product" else -((x - vector) ** 2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, _, _ = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(n)[row].as_py() for n in ("ids", "starts", "vectors", "codes", "norms", "queries", "wanted")}
                ids, starts, query_ids = (np.frombuffer(cell[n], np.int64) for n in ("ids", "starts", "queries"))
                least, many = ids[starts[:-1]], np.diff(starts)
                x = np.frombuffer(cell["vectors"], kind).reshape(-1, size)
                codes = np.frombuffer(cell["codes"], np.uint8).reshape(len(x), -1)
                norms = np.frombuffer(cell["norms"], np.float32)
                wanted = np.frombuffer(cell["wanted"], kind).reshape(-1, size)
                plain = np.flatnonzero(np.isnan(norms))
                beyond = x[plain].astype(np.float64)
                out_q, out_v, out_s = [], [], []
                for q, vector in zip(query_ids.tolist(), wanted.astype(np.float64)):
                    lookup = books @ _small(vector)  # books by words
                    near = np.zeros(len(x), np.float32)
                    for b in range(len(books)):
                        near += lookup[b][codes[:, b]]
                    if measure == "distance":
                        near = 2 * near - norms
                    near[plain] = -np.inf
                    some = best_of(near, least, rerank + 1)
                    if len(plain):
                        some = np.union1d(some, plain[best_of(scores(beyond, vector), least[plain], k + 1)])
                    exact = np.repeat(scores(x[some].astype(np.float64), vector), many[some])
                    mine = np.concatenate([ids[starts[i] : starts[i + 1]] for i in some])
                    other = mine != q
                    exact, mine = exact[other], mine[other]
                    top = best_of(exact, mine, k)
                    out_q += [q] * len(top)
                    out_v.append(mine[top])
                    out_s.append(exact[top])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], ["query_id", "vec_id", "score"])

    return run


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of float, or of double where the components are no floats) of the rows that take part."""
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    fine = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _dealt(cells: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows (cell, vec_id, v) with their block in the cell, and how many blocks each cell has (at most CELLS numbers)."""
    blocks = {r["cell"]: -(-r["count"] // most) for r in cells.groupBy("cell").count().collect()}
    many = F.create_map(*[F.lit(x) for pair in (blocks or {-1: 1}).items() for x in pair])
    return cells.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), many[F.col("cell")].cast("long"))), blocks


def search(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "product", rerank: int = RERANK, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of queries (vec_id, embedding).

    measure: "product" (largest inner product) or "distance" (least squared distance, as its
    negative). cells: how many (by default after the number of rows). probes: how many of them a
    query visits (by default as measured).
    """
    spark = vectors.sparkSession
    base, asked = sound(vectors), sound(queries).distinct()
    schema = "query_id long, rank int, vec_id long, score double"
    cells = cells or max(1, min(CELLS, base.count() // CELL_ROWS))
    few = base.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE)
    one = few.groupBy(F.lit(0).alias("all")).applyInArrow(_train_rows(cells, k, measure), "books binary, size int, centres binary, probes int, longest double").first()
    if one is None:
        return spark.createDataFrame([], schema)
    size = one["size"]
    books, centres = (np.frombuffer(one[n], np.float32) for n in ("books", "centres"))
    # Half a megabyte for 64 dimensions, and a vector for each cell.
    sent = spark.sparkContext.broadcast((books.reshape(BOOKS, WORDS, size), centres.reshape(-1, size), one["longest"]))
    base, asked = base.where(F.size("v") == size), asked.where(F.size("v") == size)
    kind = base.schema["v"].dataType.simpleString()
    rows = f"cell int, vec_id long, v {kind}"
    mine, blocks = _dealt(base.mapInArrow(_to_cells(sent, None, measure), rows), BLOCK_ROWS)
    wanted, _ = _dealt(asked.select("vec_id", F.col("v").cast(kind).alias("v")).mapInArrow(_to_cells(sent, probes or one["probes"], measure), rows), BLOCK_QUERIES)
    coded = mine.groupBy("cell", "block").applyInArrow(_coded(sent, k), "cell int, block long, ids binary, starts binary, vectors binary, codes binary, norms binary")
    wanted = wanted.groupBy("cell", "block").applyInArrow(_query_block, "cell int, queries binary, wanted binary")
    # The stated queries against the rows of their cells, in blocks: each block of queries goes to every block of its cell.
    many = F.create_map(*[F.lit(x) for pair in (blocks or {-1: 1}).items() for x in pair])[F.col("cell")]
    visits = wanted.where(many.isNotNull()).select("cell", "queries", "wanted", F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)).alias("block"))
    found = (
        coded.join(visits, ["cell", "block"])
        .select("ids", "starts", "vectors", "codes", "norms", "queries", "wanted")
        .mapInArrow(_visit(sent, "f4" if "float" in kind else "f8", size, k, rerank, measure), "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), 20)
