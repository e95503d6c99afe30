"""Session manifests: reading with defaults, listing folders, writing by session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import safe_session_id

#: Fields with their kinds and defaults.
FIELDS = {
    "completionState": ("string", ""), "integrityState": ("string", ""), "schemaVersion": ("int", 0), "createdWallTimeMillis": ("long", 0), "createdElapsedRealtimeNanos": ("long", 0), "deviceBrand": ("string", ""), "deviceManufacturer": ("string", ""),
    "deviceModel": ("string", ""), "deviceName": ("string", ""), "rawPointCount": ("int", 0), "trackPointCount": ("int", 0), "weakTrackPointCount": ("int", 0), "segmentCount": ("int", 0), "gapCount": ("int", 0), "totalDistanceMeters": ("double", 0.0),
    "movingTimeSeconds": ("double", 0.0), "selectedTotalAscentMeters": ("double", -1.0), "selectedAscentSource": ("string", "NONE"), "barometerTotalAscentMeters": ("double", -1.0), "barometerAscentSampleCount": ("int", 0), "lastEventSeq": ("long", 0),
}


def parsed(texts: DataFrame) -> DataFrame:
    """texts (session_id, text) with read_status and every field, defaults where absent."""
    ev = F.when(F.trim("text").startswith("{"), F.try_parse_json("text"))
    status = F.when(F.col("text").isNull(), "MISSING").when(F.col("ev").isNull(), "INVALID").otherwise("OK")
    fields = [F.coalesce(F.try_variant_get("ev", f"$.{name}", kind), F.lit(default).cast(kind)).alias(name) for name, (kind, default) in FIELDS.items()]
    return texts.withColumn("ev", ev).select("session_id", status.alias("read_status"), *fields)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of a folder's sessions, newest first; ids that could leave the folder are passed over."""
    files = spark.read.text(f"{folder}/*/session.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    rows = files.withColumn("session_id", F.element_at(F.split("path", "/"), -2)).where(safe_session_id(F.col("session_id")))
    return parsed(rows).join(rows.select("session_id", "modified"), "session_id").orderBy(F.desc("modified"), "session_id")


def write(manifests: DataFrame, folder: str) -> None:
    """One folder a session; Spark's commit protocol makes each write whole or absent."""
    manifests.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(folder)


#: What an interrupted write can leave in a session's folder.
TEMPORARY = ("session.json.tmp", "track.gpx.tmp", "partial.gpx.tmp")


def clean_up(spark: SparkSession, folder: str, session_id: str) -> int:
    """Delete the known temporary files of a session in any store that Spark reaches; how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(fs.delete(path(f"{folder}/{session_id}/{name}"), False) for name in TEMPORARY)
