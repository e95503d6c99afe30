"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

1. Each text, white-space runs folded to one space, is cut into chunks at content-defined
   places: a chunk runs for at least MIN_CHUNK characters and then to the first word that
   ends in one of CUT_AFTER, or to MAX_CHUNK characters.
2. Chunks are grouped by (XXH64, length) and verified by their SHA-256: a chunk's identifier
   is the place (document, ordinal) where its digest was first seen, so that two chunks share
   an identifier only when their digests and lengths agree.
3. A document's recipe is its ordered list of identifiers. Documents with equal recipes (and,
   as a last check, equal whole-text digests) form a group; its smallest id stays.

exact_groups() shuffles only digests and identifiers, never a text. Null texts count as empty;
an empty text has an empty recipe. Texts of any length are cut whole. Rows with a null id come
last in their group; a group that has no other has a null keep_id. Repeated rows with one id:
each is returned, and all of them are kept or dropped alike. Extra columns, whatever their
names, are ignored. An empty table gives an empty result.

keep_one() returns rows, so it decides by row: of each group one row stays, that with the
smallest id (null last) and, of several, the one with the smallest digest of its raw text; of
rows equal in id and text one stays. A row goes only for one of its own group, so an id that
is used for several texts loses none that is unique. All columns are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import checkpoints, row_key, rows_of, table

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Letters after which, before a space, a chunk may end.
CUT_AFTER = "dgry.,"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"


def normalised(text: str = "text") -> F.Column:
    """The text with each white-space run folded to one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_RUN, " ")


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: dict[str, F.Column] | None = None) -> DataFrame:
    """doc_id, sha (of the whole normalised text), chunks: array of (ordinal, xxh, size, sha); and more columns of docs."""
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[{CUT_AFTER}] )|.{{1,{MAX_CHUNK}}}"
    more = more or {}
    cut = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"), *[c.alias(n) for n, c in more.items()]).select(
        "doc_id", F.sha2("norm", 256).alias("sha"), F.regexp_extract_all("norm", F.lit(pattern), F.lit(0)).alias("parts"), *more
    )
    return cut.select(
        "doc_id",
        "sha",
        F.transform("parts", lambda c, i: F.struct(i.alias("at"), F.xxhash64(c).alias("xxh"), F.octet_length(c).alias("size"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("chunks"),
        *more,
    )


def _known(docs: DataFrame, doc_id: str, text: str, more: dict[str, F.Column] | None = None) -> DataFrame:
    """doc_id, sha, recipe and more columns of every row."""
    checkpoints(docs.sparkSession)
    # The texts are read once; from here on only ids and digests move. Every row gets a key of
    # its own, so that repeated ids don't mix their recipes.
    rows = recipes(docs, doc_id, text, more).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    places = rows.select("row", last.alias("doc"), F.explode("chunks").alias("c")).select("row", "doc", "c.*")
    # Written, so that its side of the join is dealt apart and a hot chunk's many places can be split.
    store = places.groupBy("xxh", "size", "digest").agg(F.min(F.struct("doc", "at")).alias("id")).checkpoint()
    lists = (
        places.select("row", "at", "xxh", "size", "digest")
        .join(store, ["xxh", "size", "digest"])
        .groupBy("row")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("recipe"))
    )
    return rows.select("row", "doc_id", "sha", *(more or {})).join(lists, "row", "left").select(
        "doc_id", "sha", F.coalesce("recipe", F.array().cast("array<struct<doc:bigint,at:int>>")).alias("recipe"), *(more or {})
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    known = _known(docs, doc_id, text)
    groups = (
        known.groupBy("recipe", "sha")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .checkpoint()
    )
    # Only groups of two or more are joined back; a hot group is one row there, and the side
    # with its many documents is split by the skew join.
    return known.join(groups, ["recipe", "sha"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with the columns of docs."""
    known = _known(docs, doc_id, text, {"key": row_key(doc_id, text)})
    first = known.groupBy("recipe", "sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    return rows_of(docs, first.select("first.key"), doc_id, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), s AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       text_sha256
FROM s WINDOW g AS (PARTITION BY text_sha256)
"""
