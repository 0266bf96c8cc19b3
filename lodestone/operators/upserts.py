"""Inserts, upserts and deletes as functions from old and new rows to the table that results.

Plain Parquet has no MERGE: each function is one equi-join on the key, and the caller overwrites a table or partition.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id", keep_if_null: tuple[str, ...] = ("summary",)) -> DataFrame:
    """New values win, except that a null in ``keep_if_null`` keeps the old one."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        new_value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_if_null else F.col(f"n.{c}")
        return F.when(fresh, new_value).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[value(c) for c in old.columns])


def touch(old: DataFrame, seen: DataFrame, now: datetime, key: str = "id") -> DataFrame:
    """Rows seen again get a new time, and a name and path where they had none."""
    s = seen.select(F.col(key).alias("__key"), F.col("file_name").alias("__name"), F.col("file_path").alias("__path"))
    hit = F.col("__key").isNotNull()
    return (
        old.join(s, F.col(key) == F.col("__key"), "left")
        .withColumn("last_seen_at", F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_seen_at")))
        .withColumn("file_name", F.coalesce("file_name", "__name")).withColumn("file_path", F.coalesce("file_path", "__path")).select(*old.columns)
    )


def write_vectors(old: DataFrame, new: DataFrame, model: str | None = None, key: str = "id") -> DataFrame:
    """Rows with a vector in ``new`` (one row a key) take it, and the model's name if one is given; a null vector changes nothing."""
    side = new.where("embedding is not null").select(F.col(key).alias("__key"), F.col("embedding").alias("__vector"))
    both = old.join(side, F.col(key) == F.col("__key"), "left").withColumn("embedding", F.coalesce("__vector", "embedding"))
    if model is not None:
        both = both.withColumn("embed_model", F.when(F.col("__key").isNotNull(), F.lit(model)).otherwise(F.col("embed_model")))
    return both.select(*old.columns)


def needs_embedding(active: str, restale: bool = False) -> Column:
    """Text without a vector, or (if asked) with one of another model."""
    other = ~F.col("embed_model").eqNullSafe(F.lit(active)) if restale else F.lit(False)
    return F.col("content").isNotNull() & F.rlike("content", F.lit(r"\S")) & (F.col("embedding").isNull() | other)


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame) -> DataFrame:
    """Old rows of a scope's (repo, blob_id) or (repo, file_path) go, then the new come; one anti join for each key."""
    by_blob = old.join(scope.select("repo", "blob_id").distinct(), ["repo", "blob_id"], "left_anti")
    return by_blob.join(scope.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti").select(*old.columns).unionByName(new)


def cascade(table: DataFrame, gone: DataFrame, key: str = "repository_id") -> DataFrame:
    """A table without the rows of deleted repositories."""
    return table.join(gone.select(key), key, "left_anti").select(*table.columns)


def create_repository(repos: DataFrame, name: str, description: str | None, now: datetime) -> DataFrame:
    """The repositories with one more; a name that is taken is refused."""
    if not repos.where(F.col("name") == name).isEmpty():
        raise ValueError(f"repository {name!r} exists")
    row = repos.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("int").alias("id")).select("id", F.lit(name).alias("name"), F.lit(description).cast("string").alias("description"), F.lit(now).cast("timestamp_ntz").alias("created_at"))
    return repos.unionByName(row)


def to_pointers(blobs: DataFrame, keep_like: tuple[str, ...]) -> DataFrame:
    """Content out, its first 500 characters in place of a missing summary; repositories like ``keep_like`` stay full."""
    full = F.lit(False)
    for p in keep_like:
        full = full | F.col("repo").like(p)
    move = ~full & F.col("content").isNotNull() & ~F.col("storage_mode").eqNullSafe(F.lit("pointer"))
    return (
        blobs.withColumn("summary", F.when(move, F.coalesce("summary", F.left("content", F.lit(500)))).otherwise(F.col("summary")))
        .withColumn("storage_mode", F.when(move, "pointer").otherwise(F.col("storage_mode"))).withColumn("content", F.when(~move, F.col("content")))
    )
