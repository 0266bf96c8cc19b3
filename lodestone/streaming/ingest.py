"""Incremental ingest: new files are hashed, met once per content, parsed, and merged into the blob and symbol tables.

Each micro-batch rewrites only what it must: unseen blobs are appended under their batch number, so a batch that runs again
after a failure replaces its own folder and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators import filters
from lodestone.parse import frames

SCHEMA = "repo string, file_path string, content string, seen_at timestamp"


def read(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A folder of JSON lines files as a stream of file versions."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(path)


def new_blobs(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Walkable text files by content hash, each content once within the watermark."""
    kept = stream.where(filters.is_walked(F.col("file_path")) & filters.within_size(F.col("file_path"), F.octet_length("content")))
    return kept.withColumn("id", hashing.blob_hash(F.col("content"))).withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["id"])


def start(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str):
    """Write blobs and their symbols under ``target``; contents that earlier batches hold are skipped by an anti join on the hash."""
    def write(batch: DataFrame, number: int) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/blobs")
        fresh = batch
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            known = spark.read.schema("id string, batch long").option("basePath", f"{target}/blobs").parquet(f"{target}/blobs").where(F.col("batch") != number).select("id")
            fresh = batch.join(known, "id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/blobs/batch={number}")
        files = spark.read.parquet(f"{target}/blobs/batch={number}")
        frames.symbols(files).write.mode("overwrite").parquet(f"{target}/symbols/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Files seen per repository and window, with late rows up to the watermark."""
    return events.withWatermark("seen_at", lateness).groupBy(F.window("seen_at", window), "repo").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("file_path").alias("n_files"))
