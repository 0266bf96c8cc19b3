"""Plumbing that the corpus operators share: whole-text access, the shared folder and size-checked joins."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was measured and has no more rows and no more bytes than this; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A key with more than one in HOT_KEYS of the rows (and HOT_ROWS at least) is hot, so there are at most HOT_KEYS hot keys.
HOT_KEYS, HOT_ROWS = 512, 10_000
#: Arrow batches stay under this size, so that a Python worker's memory does not follow the length of the texts.
BATCH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes and rows; texts differ in length by four orders of magnitude.

    The session keeps the setting, since results are lazy and Spark reads it when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(texts: list[bytes], size: int = 2 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``size`` bytes, so that what is made of them stays small; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > size:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


@functools.cache
def _own_folder() -> str:
    """Only for a session on one machine; gone when the process ends."""
    at = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return "file://" + at


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _own_folder()).rstrip("/")


def sweep(spark: SparkSession, hours: float = 24) -> int:
    """Delete the operators' folders that are older than that; for jobs that share a long-lived folder. How many went."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in store.listStatus(at) if re.search(r"-[0-9a-f]{32}$", x.getPath().getName()) and x.getModificationTime() < (time.time() - 3600 * hours) * 1000]
    for p in old:
        store.delete(p, True)
    return len(old)


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder so that lost executors cost no rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for p in map(self.path, names):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which lazy results still read."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)
        self.drop(*{x.getPath().getName() for x in found} - set(names))


def bounded(side: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` marked for broadcast if its rows and their bytes (as JSON text) are few. ``side`` should be a written table."""
    n, held = side.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(side) if n <= rows and held <= size else side


def hot_keys(rows: DataFrame, key: str, n: str | None = None) -> list:
    """The hot keys of a written table; ``n`` names a column that counts rows, if there is one."""
    one = F.col(n) if n else F.lit(1)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(one).alias("n")).where(F.col("n") > HOT_ROWS)
    most = rows.agg(F.sum(one)).first()[0] or 0
    return [r[0] for r in counts.where(F.col("n") * HOT_KEYS > most).select(key).collect()] if most > HOT_ROWS else []


def join_hot(rows: DataFrame, side: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join on ``key``, which has few rows in ``side``: those of the hot keys go to every task, so that no key's rows meet in one."""
    if not hot:
        return rows.join(side, key)
    warm = lambda df: df.where(F.col(key).isin(hot))
    cold = lambda df: df.where(~F.col(key).isin(hot))
    return warm(rows).join(F.broadcast(warm(side)), key).unionByName(cold(rows).join(cold(side), key))


def fresh(taken: list[str], name: str) -> str:
    """``name``, or it with underscores behind, that no column has (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_hash(text: str = "text") -> Column:
    """Tells rows of one id apart by their text; null and empty texts differ."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the written table ``gone`` (doc_id, h) does not name by id, null or not, and text."""
    i, h = fresh(docs.columns, "gone_id"), fresh(docs.columns, "gone_h")
    side = bounded(gone.select(F.col("doc_id").alias(i), F.col("h").alias(h)))
    return docs.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (text_hash() == F.col(h)), "left_anti")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))
