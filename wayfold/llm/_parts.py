"""Dealing documents into bounded parts, and arranging a part's rows the same way each time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._tables import volume

#: Stands for a null id: above all others.
LAST = (1 << 63) - 1
#: Tasks that parts are dealt to, at most, unless the cluster has more cores.
MOST_TASKS = 20_000


def deal(docs: DataFrame, doc_id: str, text: str, part_bytes: int) -> tuple[DataFrame, int, int]:
    """docs as (part, doc_id, text), dealt by hash, how many parts, and the bytes of text.

    The number of parts follows the text, so a part stays near part_bytes.
    """
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    _, size = volume(thin, "text")
    parts = max(1, -(-size // part_bytes))
    # Never null, and known not to be: joins on it then add no filter below the exchange that others reuse.
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"), F.lit(0))
    return thin.select(part.alias("part"), "doc_id", "text"), parts, size


def tasks(spark: SparkSession, parts: int) -> int:
    """Shuffle partitions for so many parts: one a part for small inputs, then several parts to each.

    A task takes its parts one after another, so its memory is that of one part.
    """
    return min(parts, max(MOST_TASKS, 4 * spark.sparkContext.defaultParallelism))


def arranged(rows: pa.Table, only=None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A part's rows by id, equal ids by text: the ids, them as numbers (null: LAST), bytes and row starts.

    only: which of them to take, as a mask, given the ids as numbers.
    """
    rows = rows.combine_chunks()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])) if rows.num_rows > 1 else rows
    ids = rows.column("doc_id").combine_chunks()
    order = pc.fill_null(ids, LAST).to_numpy(zero_copy_only=False)
    if only is not None:
        mask = pa.array(only(order))
        rows, ids, order = rows.filter(mask), ids.filter(mask), order[mask.to_numpy(zero_copy_only=False)]
    data, off = _text.column_bytes(rows.column("text").cast(pa.large_string()))
    return ids, order, data, off


def lots(off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows [a, b) of about so many bytes at most; a longer row is alone."""
    out, a = [], 0
    rows = len(off) - 1
    while a < rows:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(max(b, a + 1), rows)
        out.append((a, b))
        a = b
    return out
