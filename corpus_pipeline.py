"""The corpus pipeline: quality, exact copies, near copies, mixing, encoding.

Each stage works on all that its predecessor kept and takes (spark, docs, sf_dir). All but the
last return the columns of documents; the last returns them with ids in place of the text. run()
writes each stage's rows once to the shared folder, and the next stage reads them from there.

Rows are judged as rows: a null text is an empty one, a null id the largest one, and of repeated
rows the exact stage leaves one. Texts are taken whole. Extra columns go along, whatever their
names, but for n_tokens and ids, which the last stage writes. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import exact_dedup, mixing, quality, sentencepieces, simhash
from wayfold.llm._tables import table, written

#: The classifier and the fingerprints have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document may come once in each epoch."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids."""
    return sentencepieces.with_ids(docs)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("source_mixing", source_mix),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
