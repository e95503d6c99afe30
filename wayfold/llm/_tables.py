"""Reading the shared tables, the checkpoint folder, and rows by their keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a folder of our own only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="wayfold-checkpoints-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)  # ours alone, and local
    sc.setCheckpointDir(shared)


def written(frame: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there: nothing before is run again."""
    spark = frame.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fresh(names: list[str], wish: str) -> str:
    """A column name that is none of the names."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def row_key(doc_id: str, text: str) -> F.Column:
    """A digest that only rows of equal id and equal text share."""
    whole = F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-")), F.when(F.col(f"`{text}`").isNull(), F.lit(":0")).otherwise(F.lit(":1")), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return F.unhex(F.sha2(whole, 256))


def rows_of(docs: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """For each key (column key, all different) one row of docs that has it.

    Of rows with one key, which differ in other columns at most, that with the least hash of
    those stays; equal ones are dropped before the shuffle already.
    """
    key, rank = fresh(docs.columns, "row_key"), fresh(docs.columns, "row_rank")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    one = docs.withColumn(key, row_key(doc_id, text)).withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(*plain)))).where(F.col(rank) == 1)
    return one.join(keys.select(F.col("key").alias(key)), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def volume(frame: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of a text column, in one aggregate."""
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def spread(frame: DataFrame) -> DataFrame:
    """Rows over as many tasks as there are cores, where an input of a few files would leave cores idle.

    Inputs of more splits than cores are left as they are, without a shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
