"""SimHash near-deduplication by pigeonhole blocks.

Fingerprints: 64 bits over the XXH64 (seed 42) of the 3-word shingles of the lower-cased text. Two fingerprints within
``DISTANCE`` bits agree on all but that many of ``b`` blocks, so they share at least one choice of b - DISTANCE whole
blocks; joining on every such choice loses no pair for any b. ``b`` follows the number of fingerprints, which keeps
chance meetings rare at every size.

Equal fingerprints are folded into one node first; nodes are known by their fingerprint, ids come in at the end. A block
bucket is never expanded into pairs: one pass over it yields a spanning forest of its links. The fingerprints of a bucket
with more than ``CROWDED`` go by the finest choices instead, whole blocks of 52 bits, whose buckets cannot hold more than
2^12 fingerprints. Components spread by the smallest node with pointer jumping, written to the shared folder after each round.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other; rows with
a null id link like any other, but never name a component (theirs is the smallest id of its members, null if there is
none); repeated rows are members of one node; an empty table gives an empty result; other columns are not read (or pass
through ``keep_one`` unchanged, which keeps rows that repeat both id and text alike).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, hot_keys, join_hot, raw, small_batches, text_hash, without

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints that one block bucket may hold before it goes by the finest choices of blocks.
CROWDED, FINEST = 1 << 15, 16


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: 1 - SHINGLE].tolist()]
    last = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[i:j], SEED) for i, j in zip(first, last, strict=False)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in raw(b.column(1))], np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), b.column(2), pa.array(prints)], ["doc_id", "h", "fp"])


def forest(prints: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (positions) that join all fingerprints connected by links of at most ``DISTANCE`` bits."""
    if len(prints) == 2:
        return ([0], [1]) if (int(prints[0]) ^ int(prints[1])).bit_count() <= DISTANCE else ([], [])
    a: list[int] = []
    b: list[int] = []
    rest = np.arange(len(prints))
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= DISTANCE
            if near.any():
                found = rest[near].tolist()
                a += [at] * len(found)
                b += found
                stack += found
                rest = rest[~near]
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (choice, block, fp): the links of each bucket. Only the bucket under way is held."""

    def out(groups):
        a, b = [], []
        for prints in groups:
            x, y = forest(prints)
            if x:
                a.append(prints[x])
                b.append(prints[y])
        if a:
            yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    held = None
    for batch in batches:
        keys = np.stack([c.to_numpy() for c in batch.columns[:2]], 1)
        prints = batch.column(2).to_numpy().view(np.uint64)
        if held is not None:
            keys, prints = np.concatenate([held[0], keys]), np.concatenate([held[1], prints])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        yield from out(prints[i:j] for i, j in itertools.pairwise(cuts) if j - i > 1)
        held = keys[cuts[-1] :], prints[cuts[-1] :]
    if held is not None and len(held[1]) > 1:
        yield from out([held[1]])


def _choices(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << j) - 1) ^ ((1 << i) - 1) for i, j in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(parts, blocks - DISTANCE)]


def masks(n: int) -> list[int]:
    """The choices of whole blocks for ``n`` fingerprints: the fewest blocks whose choices have log2(n) + 2 bits."""
    need = max(1, n).bit_length() + 2
    return _choices(next((b for b in range(DISTANCE + 2, FINEST) if 64 * (b - DISTANCE) / b >= need), FINEST))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(prints: DataFrame, choices: list[int]) -> DataFrame:
    """Each fingerprint with its whole blocks under every choice."""
    blocks = F.array(*[F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for i, m in enumerate(choices)])
    return prints.select("fp", F.explode(blocks).alias("k")).select("k.*", "fp")


def _linked(keyed: DataFrame) -> DataFrame:
    dealt = keyed.select("choice", "block", "fp").repartition("choice", "block").sortWithinPartitions("choice", "block")
    return dealt.mapInArrow(_links, "a long, b long")


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``DISTANCE`` bits; ``prints``: distinct fp, as a written table."""
    keyed = _keyed(prints, masks(prints.count()))
    met = scratch.save(keyed.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "met")
    found = _linked(keyed.join(met.where(F.col("n") <= CROWDED), ["choice", "block"]))
    if met.where(F.col("n") > CROWDED).limit(1).count():
        crowd = scratch.save(keyed.join(met.where(F.col("n") > CROWDED), ["choice", "block"], "left_semi").select("fp").distinct(), "crowd")
        finest = _keyed(crowd, _choices(FINEST))
        twice = scratch.save(finest.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
        found = found.union(_linked(finest.join(twice, ["choice", "block"])))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the written table ``edges`` (a, b); root: the smallest node it can reach."""
    both = scratch.save(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "both")
    labels = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels0")
    hubs, step = hot_keys(both, "v"), 0
    while True:
        step += 1
        near = join_hot(both, labels.select(F.col("node").alias("v"), "root"), "v", hubs).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("best"))
        lower = scratch.save(labels.join(near, "node").select("node", F.least("root", "best").alias("root"), (F.col("best") < F.col("root")).alias("moved")), f"lower{step}")
        if not lower.where("moved").limit(1).count():
            return labels
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = scratch.save(join_hot(lower, jump, "root", hot_keys(lower, "root")).select("node", F.col("far").alias("root")), f"labels{step}")
        scratch.drop(f"lower{step}", f"labels{step - 1}")


def _members(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, h, fp), (classes: fp, best); best: the id and text hash of the class's first row. Both written."""
    small_batches(spark)
    scratch = Scratch(spark, "simhash")
    rows = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("h")).mapInArrow(_fingerprints, "doc_id long, h long, fp long"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h"))
    nodes = scratch.save(rows.groupBy("fp").agg(first.alias("best")), "nodes")
    edges = scratch.save(links(nodes.select("fp"), scratch), "edges")
    if edges.limit(1).count():
        roots = components(edges, scratch)
        linked = scratch.save(nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "best"), "linked")
        heads = linked.groupBy("root").agg(F.min("best").alias("best"))
        classes_ = join_hot(linked.drop("best"), heads, "root", hot_keys(linked, "root")).select("fp", "best")
        nodes = nodes.join(roots, nodes.fp == roots.node, "left_anti").select("fp", "best").unionByName(classes_)
    found = scratch.save(nodes, "found")
    scratch.keep("rows", "found")
    return rows, found


def _told(rows: DataFrame, found: DataFrame) -> DataFrame:
    return join_hot(rows, found, "fp", hot_keys(rows, "fp"))


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return _told(*_members(spark, docs)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component only: that with the smallest doc_id, any id before null, then by text hash."""
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    return without(docs, Scratch(spark, "simhash-drop").save(_told(*_members(spark, docs)).where(~same).select("doc_id", "h"), "gone"))
