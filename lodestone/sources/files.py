"""Working trees, git logs, tree listings and pointer content as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hashing, paths
from lodestone.operators import filters
from lodestone.operators.stages import stored

#: Characters of a text that a tool shows, and what follows a cut.
MAX_SHOWN, CUT_NOTICE = 500_000, "\n... (truncated)"


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder that a walk would take: path (relative), name, size, content as text (null for binaries), id."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.select(F.replace(F.col("path"), F.lit(base), F.lit("")).alias("file_path"), F.col("length").alias("size"), "content")
    kept = named.where(filters.is_walked(F.col("file_path"))).withColumn("file_name", paths.basename(F.col("file_path")))
    sized = kept.where(filters.within_size(F.col("file_name"), F.col("size")))
    text = F.when(~F.contains(F.hex(F.substring("content", 1, 1024)), F.lit("\0")) & (F.locate("\0", F.col("content").cast("string")) == 0), F.col("content").cast("string"))
    git = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.col("size").cast("string"), F.char(F.lit(0))), "utf-8"), F.col("content")))
    return sized.select(git.alias("id"), "file_path", "file_name", "size", text.alias("content"), filters.is_embeddable(F.col("file_name")).alias("embeddable"))


def tree_entries(files: DataFrame) -> DataFrame:
    """Folders of a file list (file_path, id) bottom-up: (dir, name, type, object_id, tree_id), one level of folders per round."""
    rows = files.select(paths.dirname(F.col("file_path")).alias("dir"), paths.basename(F.col("file_path")).alias("name"), F.lit("blob").alias("type"), F.col("id").alias("object_id"))
    depth = F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/")))
    rows = rows.withColumn("depth", depth)
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    done = None
    for d in range(deepest, -1, -1):
        here = stored(rows.where(F.col("depth") == d))  # used twice and read by the level above
        trees = here.groupBy("dir").agg(hashing.tree_hash(F.collect_list(F.struct("name", "type", "object_id"))).alias("tree_id"))
        level = stored(here.join(trees, "dir"))
        trees = level.select("dir", "tree_id").distinct()
        done = level if done is None else done.unionByName(level)
        if d:
            up = trees.select(paths.dirname(F.col("dir")).alias("dir"), paths.basename(F.col("dir")).alias("name"), F.lit("tree").alias("type"), F.col("tree_id").alias("object_id")).withColumn("depth", depth)
            rows = rows.unionByName(up)
    return done.drop("depth")


def git_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """'hash|parents|author|subject' lines: commit, first parent, author, subject (which may hold bars)."""
    parts = F.split(line, r"\|", 4)
    return lines.select(parts[0].alias("id"), F.nullif(F.substring_index(parts[1], " ", 1), F.lit("")).alias("parent_id"), parts[2].alias("author"), parts[3].alias("message")).where(is_object_id(F.col("id")))


def tree_listing(lines: DataFrame, line: str = "value") -> DataFrame:
    """'mode type id<tab>name' lines."""
    part = lambda i: F.regexp_extract(line, r"^(\d+) (\w+) ([0-9a-fA-F]{40})\t(.*)$", i)
    return lines.select(part(1).alias("mode"), part(2).alias("type"), part(3).alias("object_id"), part(4).alias("name")).where("object_id <> ''")


def is_object_id(c: Column) -> Column:
    return F.rlike(c, F.lit("^[0-9a-fA-F]{40}$"))


def pointer_path(project: Column, path: Column) -> Column:
    """The place of a pointer's content under the root, or null where it would leave its project or holds a NUL."""
    folder = paths.basename(F.regexp_replace(project, "/+$", ""))
    inside = paths.normalise(paths.strip_root(path))
    bad = F.contains(path, F.char(F.lit(0))) | F.startswith(inside, F.lit("..")) | (inside == "") | folder.isin("", ".", "..")
    return F.when(~bad, F.concat_ws("/", folder, inside))


def with_content(pointers: DataFrame, files: DataFrame) -> DataFrame:
    """Pointers (project, file_path) with the text of their files (path relative to the root, content); null on a miss."""
    at = pointers.withColumn("__at", pointer_path(F.col("project"), F.col("file_path")))
    return at.join(files.select(F.col("path").alias("__path"), F.col("content").alias("resolved")), F.col("__at") == F.col("__path"), "left").drop("__at", "__path")


def snippet(content: Column, start: Column, end: Column, default: int = 25) -> Column:
    """Lines start to end (from 1), or ``default`` lines without an end."""
    n = F.greatest(F.lit(1), F.coalesce(end - start + 1, F.lit(default)))
    return F.array_join(F.slice(F.split(content, "\n"), F.greatest(F.lit(1), start), n), "\n")


def shown(content: Column) -> Column:
    """Text as a tool shows it: a mark for binaries, a notice behind a cut."""
    return F.when(filters.is_binary(content), "[binary content]").when(F.length(content) > MAX_SHOWN, F.concat(F.left(content, F.lit(MAX_SHOWN)), F.lit(CUT_NOTICE))).otherwise(content)
