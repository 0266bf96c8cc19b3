"""Commits of file lists as Merkle trees: stored once per content, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators.stages import stored
from lodestone.sources import files

#: Trees of one level that go to every task; more are met by a shuffle.
FEW = 100_000


def snapshot(paths: DataFrame) -> tuple[DataFrame, str | None]:
    """(entries: tree_id, name, type, object_id; id of the root tree) of files (file_path, id); no root for no files."""
    rows = stored(files.tree_entries(paths))
    root = rows.where("dir = '.'").select("tree_id").first()
    return rows.select("tree_id", "name", "type", "object_id").distinct(), root and root[0]


def insert_trees(known: DataFrame, new: DataFrame) -> DataFrame:
    """The entries of ``new`` whose trees ``known`` does not hold; a tree's id tells all its entries."""
    return new.join(known.select("tree_id").distinct(), "tree_id", "left_anti")


def commit(commits: DataFrame, root: str, message: str, branch: str = "main") -> DataFrame:
    """``commits`` (id, branch, parent_id, tree_id, message, number) with one more at the head of the branch, unless its tree is the head's own."""
    head = commits.where(F.col("branch") == branch).orderBy(F.desc("number")).limit(1)
    last = head.first()
    if last is not None and last.tree_id == root:
        return commits
    new = commits.sparkSession.range(1).select(
        hashing.commit_hash(F.lit(root), F.lit(message)).alias("id"), F.lit(branch).alias("branch"), F.lit(last and last.id).cast("string").alias("parent_id"),
        F.lit(root).alias("tree_id"), F.lit(message).alias("message"), F.lit(last.number + 1 if last else 0).cast("int").alias("number"),
    )
    return commits.unionByName(new)


def compare(entries: DataFrame, old: str | None, new: str | None, most: int = 1000) -> DataFrame:
    """(path, status, old_id, new_id) of the files that differ between two root trees: added, removed or changed.

    Level by level, only trees whose ids differ are opened, so the entries that are read grow with the change and not with the
    snapshots. A tree on one side alone is listed whole. ``most`` bounds the depth.
    """
    spark = entries.sparkSession
    told = None
    level = spark.createDataFrame([("", old, new)] if old != new else [], "prefix string, old string, new string")
    for _ in range(most):
        if told is not None and level.isEmpty():
            break
        small = level.count() <= FEW
        side = lambda which: level.where(F.col(which).isNotNull()).select("prefix", F.col(which).alias("tree_id"))  # noqa: E731, B023
        opened = lambda which: entries.join(F.broadcast(side(which)) if small else side(which), "tree_id").select("prefix", "name", F.col("type").alias(f"{which}_type"), F.col("object_id").alias(f"{which}_id"))  # noqa: E731, B023
        both = opened("old").join(opened("new"), ["prefix", "name"], "full").where(~(F.col("old_type").eqNullSafe(F.col("new_type")) & F.col("old_id").eqNullSafe(F.col("new_id"))))
        both = stored(both.withColumn("path", F.concat("prefix", "name")))
        only = lambda which, kind: F.when(F.col(f"{which}_type") == kind, F.col(f"{which}_id"))
        blobs = both.select("path", only("old", "blob").alias("old_id"), only("new", "blob").alias("new_id")).where("old_id is not null or new_id is not null")
        blobs = blobs.select("path", F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").otherwise("changed").alias("status"), "old_id", "new_id")
        told = blobs if told is None else told.unionByName(blobs)
        level = both.select(F.concat("path", F.lit("/")).alias("prefix"), only("old", "tree").alias("old"), only("new", "tree").alias("new")).where("old is not null or new is not null")
    else:
        raise ValueError(f"deeper than {most}")
    return told
