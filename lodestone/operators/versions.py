"""Latest versions of files, ordered deduplication and exact duplicate removal.

A blob is superseded if another of the same (repo, path) has a greater (last seen or created, id); a null path never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEGINNING = "0001-01-01 00:00:00"


def version_time(seen: str = "last_seen_at", created: str = "created_at") -> Column:
    return F.coalesce(F.col(seen), F.col(created), F.lit(_BEGINNING).cast("timestamp_ntz"))


def latest_by_window(blobs: DataFrame) -> DataFrame:
    """One shuffle on (repo, path); pathless rows do not take part in it."""
    w = Window.partitionBy("repo", "file_path").orderBy(version_time().desc(), F.col("id").desc())
    newest = blobs.where("file_path is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return newest.unionByName(blobs.where("file_path is null"))


def latest_by_antijoin(blobs: DataFrame) -> DataFrame:
    """The same rows, as those without a greater rival."""
    rival = blobs.select(F.col("repo").alias("r"), F.col("file_path").alias("p"), version_time().alias("t"), F.col("id").alias("i"))
    greater = (F.col("t") > version_time()) | ((F.col("t") == version_time()) & (F.col("i") > F.col("id")))
    return blobs.join(rival, (F.col("repo") == F.col("r")) & (F.col("file_path") == F.col("p")) & greater, "left_anti")


def drop_superseded(candidates: DataFrame, blobs: DataFrame, most: int) -> DataFrame:
    """``candidates`` (at most ``most`` rows, by a limit) without those that any row of ``blobs`` supersedes.

    Their few paths go to every partition of ``blobs``, whose matching rows alone are aggregated.
    """
    keys = F.broadcast(candidates.where("file_path is not null").select("repo", "file_path").distinct().limit(most))
    newest = blobs.join(keys, ["repo", "file_path"]).groupBy("repo", "file_path").agg(F.max(F.struct(version_time().alias("t"), F.col("id").alias("i"))).alias("__top"))
    return candidates.join(F.broadcast(newest.limit(most)), ["repo", "file_path"], "left").where("file_path is null or __top.i = id").drop("__top")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def drop_exact_duplicates(df: DataFrame, keys: list[str], row_id: str = "id") -> DataFrame:
    """Of equal keys the greatest id; rows with a null in the key never equal another and stay."""
    whole = " and ".join(f"{k} is not null" for k in keys)
    return distinct_on(df.where(whole), keys, [F.col(row_id).desc()]).unionByName(df.where(f"not ({whole})"))


def purge_stale(details: DataFrame, blobs: DataFrame) -> DataFrame:
    """Details (repo, file_path, blob_id, ...) whose blob is the latest of its path, or whose path has no blob."""
    latest = distinct_on(blobs.where("file_path is not null"), ["repo", "file_path"], [F.col("last_seen_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id").desc()])
    last = latest.select("repo", "file_path", F.col("id").alias("__latest"))
    return details.join(last, ["repo", "file_path"], "left").where("__latest is null or blob_id <=> __latest").drop("__latest")
