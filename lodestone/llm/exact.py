"""Exact deduplication with static binary-fuse filters per immutable snapshot.

Each text is reduced to the SHA-256 of its normalised form (A-Z lower-cased, null as empty). The digests of the snapshot
are grouped, dealt into hash buckets, and a binary-fuse filter is built for each bucket; both are written once and serve
every later batch (``take_snapshot``, ``Snapshot``, ``against``). Incoming digests are grouped among themselves first (so
duplicates within the new batch are settled there), then screened by the filters; only positives meet the snapshot's
exact buckets, where the texts of both groups' heads are compared byte by byte.

Hot groups: every grouping has a partial aggregate in front of it, the filter buckets hold distinct digests only, and
in the last join the digests of mass copies go to every task (``join_hot``). Texts meet heads by a broadcast of the heads'
ids while those are few (``bounded``); beyond that the texts are shuffled once.

Defined results: the row with the largest doc_id of equal texts stays (null ids lose to any other); rows that repeat the
id and are equal, and rows of a group without any id, count as members of the group and are kept or dropped alike; an empty table gives
an empty result; other columns are not read (or pass through ``drop_duplicates`` unchanged).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, bounded, hot_keys, join_hot, lower_ascii, raw, small_batches, text_hash, whole, without

#: Distinct digests that one filter holds at most on average, and the least number of filters.
KEYS_PER_FILTER, MIN_FILTERS = 1 << 18, 512
FINGERPRINT = np.uint16


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """Three-wise binary-fuse filter over distinct 64-bit keys: no false negatives, about 2^-16 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> list[np.ndarray]:
        first = (h >> np.uint64(32)) * np.uint64(segments * segment) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        return [x.astype(np.int64) for x in (first, (first + np.uint64(segment)) ^ (h >> np.uint64(18) & mask), (first + np.uint64(2 * segment)) ^ (h & mask))]

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(FINGERPRINT)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys)
        n = max(2, len(keys))
        segment = min(1 << 18, 1 << max(2, int(np.log(n) / np.log(3.33) + 2.25)))
        capacity = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))) + segment
        segments = max(1, -(-capacity // segment) - 2)
        for seed in range(1, 1000):
            if (order := cls._peel(h := _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 63) - 1), segment, segments)) is not None:
                break
        else:
            raise ValueError("no seed peels these keys")
        slots, prints = cls._slots(h, segment, segments), cls._print(h)
        table = np.zeros((segments + 2) * segment, FINGERPRINT)
        for k, at in reversed(order):  # the keys of one round share no slot that the round settles
            table[at] = 0
            table[at] = prints[k] ^ table[slots[0][k]] ^ table[slots[1][k]] ^ table[slots[2][k]]
        return cls(seed * 0x9E3779B97F4A7C15 & (1 << 63) - 1, segment, segments, table)

    @classmethod
    def _peel(cls, h: np.ndarray, segment: int, segments: int) -> list | None:
        """Rounds of (keys, their slots): each key is alone in its slot once the earlier rounds' keys are gone."""
        slots = cls._slots(h, segment, segments)
        count = np.zeros((segments + 2) * segment, np.int64)
        total = np.zeros_like(count)  # sum of the keys' numbers in a slot: the number itself when one is left
        number = np.arange(len(h))
        for s in slots:
            np.add.at(count, s, 1)
            np.add.at(total, s, number)
        order, left, near = [], len(h), np.arange(len(count))
        while left:
            alone = near[count[near] == 1]
            if not len(alone):
                return None
            k, first = np.unique(total[alone], return_index=True)
            order.append((k, alone[first]))
            left -= len(k)
            for s in slots:
                np.subtract.at(count, s[k], 1)
                np.subtract.at(total, s[k], k)
            near = np.unique(np.concatenate([s[k] for s in slots]))
        return order

    def may_contain(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys, self.seed)
        a, b, c = self._slots(h, self.segment, self.segments)
        return self.table[a] ^ self.table[b] ^ self.table[c] == self._print(h)


def _keys(digests: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(x[:8], "little") for x in digests.to_pylist()], np.uint64)


def _build(group: pa.Table) -> pa.Table:
    f = BinaryFuse.build(_keys(group.column("digest").combine_chunks()))
    return pa.table({"bucket": group.column("bucket")[:1], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "bits": pa.array([f.table.tobytes()], pa.binary())})


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    columns = ["digest", "head", "n"]
    if not filters.num_rows or not incoming.num_rows:
        return incoming.slice(0, 0).select(columns)
    x = filters.to_pylist()[0]
    f = BinaryFuse(x["seed"], x["segment"], x["segments"], np.frombuffer(x["bits"], FINGERPRINT))
    return incoming.filter(pa.array(f.may_contain(_keys(incoming.column("digest").combine_chunks())))).select(columns)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(2), pa.array([hashlib.sha256(t.lower()).digest() for t in raw(b.column(1))], pa.binary()), b.column(3)], ["doc_id", "h", "digest", "old"])


def _bucket(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket")


_GROUPS = "digest binary, head struct<named:boolean,doc_id:bigint,h:bigint>, n long"


def digests(docs: DataFrame, old: Column) -> DataFrame:
    """One row per document: doc_id, h, digest, old."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("h"), old.alias("old")).mapInArrow(_digest, "doc_id long, h long, digest binary, old boolean")


def _grouped(rows: DataFrame) -> DataFrame:
    """Per digest its head, the row with the largest id (null last; of ties the one with the largest hash), and its size."""
    head = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "h"))
    return rows.groupBy("digest").agg(head.alias("head"), F.count(F.lit(1)).alias("n"))


class Snapshot:
    """The groups and filters of a written, immutable snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.groups = spark.read.schema(_GROUPS).parquet(f"{path}/groups")
        self.filters = spark.read.schema("bucket int, seed long, segment long, segments long, bits binary, buckets int").parquet(f"{path}/filters")
        first = self.filters.select("buckets").first()
        self.buckets = first[0] if first else MIN_FILTERS


def take_snapshot(spark: SparkSession, rows: DataFrame, path: str) -> Snapshot:
    """Write the groups of ``rows`` (from ``digests``) and one filter a bucket over their digests; a path that is taken is refused."""
    _grouped(rows).write.option("compression", "zstd").parquet(f"{path}/groups")
    groups = spark.read.schema(_GROUPS).parquet(f"{path}/groups")
    n = max(MIN_FILTERS, -(-groups.count() // KEYS_PER_FILTER))
    filters = groups.select(_bucket(n), "digest").groupBy("bucket").applyInArrow(_build, "bucket int, seed long, segment long, segments long, bits binary")
    filters.withColumn("buckets", F.lit(n)).write.option("compression", "zstd").parquet(f"{path}/filters")
    return Snapshot(spark, path)


def _matched(new: DataFrame, snapshot: Snapshot, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The new groups (digest, head, n) that the snapshot holds too, by filter, digest and bytes: digest, best, all. ``docs`` has the texts of both."""
    n = snapshot.buckets
    positive = new.select(_bucket(n), "*").groupBy("bucket").cogroup(snapshot.filters.drop("buckets").groupBy("bucket")).applyInArrow(_screen, _GROUPS)
    both = scratch.save(scratch.save(positive, "positive").join(snapshot.groups.select("digest", F.col("head").alias("old_head"), F.col("n").alias("old_n")), "digest"), "both")
    heads = scratch.save(both.select("digest", F.explode(F.array("head", "old_head")).alias("x")).select("digest", F.col("x.doc_id").alias("i"), F.col("x.h").alias("k")), "heads")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("h")).join(bounded(heads), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")))
    forms = texts.select("digest", lower_ascii(whole()).alias("form")).where(F.unhex(F.sha2("form", 256)) == F.col("digest"))
    same = forms.groupBy("digest").agg(F.count_distinct("form").alias("forms")).where("forms = 1").select("digest")
    return scratch.save(both.join(same, "digest").select("digest", F.greatest("head", "old_head").alias("best"), (F.col("n") + F.col("old_n")).alias("all")), "equal")


def groups(spark: SparkSession, docs: DataFrame, scratch: Scratch, is_old: Column) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, h, digest, old), (groups: digest, old, head, n); ``is_old`` tells the snapshot's rows from the new."""
    small_batches(spark)
    rows = scratch.save(digests(docs, is_old), "rows")
    snapshot = take_snapshot(spark, rows.where("old"), scratch.path("snapshot"))
    new = scratch.save(_grouped(rows.where("not old")), "new")
    equal = _matched(new, snapshot, docs, scratch)
    sides = snapshot.groups.select("digest", F.lit(True).alias("old"), "head", "n").unionByName(new.select("digest", F.lit(False).alias("old"), "head", "n"))
    done = scratch.save(sides.join(equal, "digest", "left").select("digest", "old", F.coalesce("best", "head").alias("head"), F.coalesce("all", "n").alias("n")), "groups")
    scratch.keep("rows", "groups")
    return rows, done


def default_split() -> Column:
    """Half of the ids, by hash, as the snapshot that was there before."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def _members(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each row with its group's head and n; both sides of a digest's split in two have the same head."""
    key = lambda df: df.withColumn("key", F.concat("digest", F.when(F.col("old"), F.lit(b"1")).otherwise(F.lit(b"0")))).drop("old")
    found = key(found)
    return join_hot(key(rows), found.drop("digest"), "key", hot_keys(found, "key", "n"))


def _told(rows: DataFrame) -> DataFrame:
    keep = F.col("head.doc_id")
    return rows.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def classes(spark: SparkSession, docs: DataFrame, is_old: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _told(_members(*groups(spark, docs, Scratch(spark, "exact"), default_split() if is_old is None else is_old)))


def against(spark: SparkSession, snapshot: Snapshot, old_docs: DataFrame, new_docs: DataFrame) -> DataFrame:
    """One row per document of a new batch, as in ``classes``, with its group in the batch and the snapshot together."""
    small_batches(spark)
    scratch = Scratch(spark, "exact-batch")
    rows = scratch.save(digests(new_docs, F.lit(False)), "rows")
    new = scratch.save(_grouped(rows), "new")
    equal = _matched(new, snapshot, old_docs.select("doc_id", "text").union(new_docs.select("doc_id", "text")), scratch)
    found = scratch.save(new.join(equal, "digest", "left").select("digest", F.lit(False).alias("old"), F.coalesce("best", "head").alias("head"), F.coalesce("all", "n").alias("n")), "groups")
    scratch.keep("rows", "groups")
    return _told(_members(rows, found))


def drop_duplicates(spark: SparkSession, docs: DataFrame, is_old: Column | None = None) -> DataFrame:
    """``docs`` without the rows that a larger doc_id with an equal text supersedes."""
    scratch = Scratch(spark, "exact-drop")
    rows, found = groups(spark, docs, scratch, default_split() if is_old is None else is_old)
    gone = _members(rows, found.where("n > 1")).where(~F.col("doc_id").eqNullSafe(F.col("head.doc_id")))
    return without(docs, scratch.save(gone.select("doc_id", "h"), "gone"))
