"""Near-deduplication of embeddings by iterative quantisation and multi-index Hamming tables.

Vectors of a label and length link at a cosine of ``COSINE`` or more. Equal vectors are folded into one node first. For each
length a rotation is learned on a bounded sample: the principal directions, turned by alternating between the signs of the
rotated sample and the best rotation onto them (Gong and Lazebnik), so that its bits are balanced and lie far from the
sample. Several such rotations, each from another random start, give the code of a node. The code is cut into substrings,
and each is an exact-match table; their width follows the number of nodes, and their number the width, so that a pair at the
very threshold shares a table with a chance of ``SURE``.

Nodes that meet in a table bring their vectors and are compared in double precision, in blocks of bounded size. A pair counts
in the first table where it meets, so that sums of links need no list of pairs; a block emits the sums of its nodes and a
spanning forest of its links, never its pairs. A bucket beyond ``BLOCK`` nodes is dealt to one task per pair of its parts.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing and are components of their own; rows without an id link like any other but never name a component (a
component without any id has null, and its rows are not kept); rows that repeat an id are vectors of their own; an empty
table gives an empty result; other columns are not read. Links are found with high probability and never invented.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, hot_keys, join_hot, small_batches
from lodestone.llm.simhash import components

COSINE = 0.98
#: Chance that a pair at the threshold shares a table, if its bits differ as under random directions.
SURE = 0.9995
#: Vectors of a length that its rotations are fitted on at most, rounds of the fit, lengths with a fitted rotation at most (others turn at random).
SAMPLE, ROUNDS, FITTED = 4096, 30, 16
#: Nodes of one part of a bucket, on average.
BLOCK = 1024


def tables(nodes: int) -> tuple[int, int]:
    """(bits of a substring, number of tables) for so many nodes of one label and length."""
    bits = min(28, max(8, nodes.bit_length() + 1))
    met = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - SURE) / math.log(1 - met))


def rotations(sample: np.ndarray, dims: int, bits: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions: dims x bits): as many learned rotations as the bits need, side by side."""
    rng = np.random.default_rng(seed)
    parts, width = [], 0
    mean = sample.mean(axis=0) if len(sample) > dims else np.zeros(dims)
    centred = sample - mean
    main = np.linalg.eigh(centred.T @ centred)[1][:, ::-1] if len(sample) > dims else np.eye(dims)
    flat = centred @ main
    while width < bits:
        turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(ROUNDS if len(sample) > dims else 0):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        parts.append(main @ turn)
        width += dims
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unpack(cells: list[bytes], dims: int) -> np.ndarray:
    """Vectors as doubles; those that single precision can hold are stored in it."""
    kinds = {len(c) for c in cells}
    if len(kinds) == 1:
        return np.frombuffer(b"".join(cells), "<f4" if kinds == {4 * dims} else "<f8").reshape(-1, dims).astype(np.float64)
    return np.stack([np.frombuffer(c, "<f4" if len(c) == 4 * dims else "<f8").astype(np.float64) for c in cells])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, embedding -> vec_id, label, dims, digest, vec; the last three are null where a vector links with nothing."""
    for b in batches:
        labels, vectors = b.column(1), b.column(2).cast(pa.list_(pa.float64()))
        flat = vectors.flatten()
        values = flat.fill_null(math.nan).to_numpy(zero_copy_only=False)
        sizes = np.array([n or 0 for n in vectors.value_lengths().to_pylist()], np.int64)
        dims, digests, packed, at = [], [], [], 0
        for label, n in zip(labels.to_pylist(), sizes.tolist(), strict=True):
            v, at = values[at : at + n], at + n
            if label is None or not n or not v.any() or not np.isfinite(v).all():
                dims.append(None)
                digests.append(None)
                packed.append(None)
                continue
            v = v + 0.0  # one zero
            with np.errstate(over="ignore"):
                small = v.astype(np.float32)
            cell = (small if (small == v).all() else v).tobytes()
            dims.append(n)
            digests.append(hashlib.blake2b(f"{len(label)}:{label}{n}:".encode() + cell, digest_size=16).digest())
            packed.append(cell)
        yield pa.record_batch([b.column(0), labels, pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "label", "dims", "digest", "vec"])


def _coder(models: dict[int, tuple[np.ndarray, np.ndarray]], bits: int, count: int):
    weights = (1 << np.arange(bits, dtype=np.int64))[::-1]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, dims, vec -> node, the number in each table."""
        for b in batches:
            dims, cells = b.column(1).to_numpy(), b.column(2).to_pylist()
            out = np.zeros((len(cells), count), np.int32)
            for d in np.unique(dims).tolist():
                if d not in models:
                    models[d] = rotations(np.zeros((0, d)), d, bits * count)
                mean, directions = models[d]
                at = np.flatnonzero(dims == d)
                for part in np.array_split(at, -(-len(at) // 1024)):
                    signs = ((unit(unpack([cells[i] for i in part], d)) - mean) @ directions > 0).reshape(len(part), count, bits)
                    out[part] = (signs * weights).sum(axis=2)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, count), pa.int32()), pa.array(out.ravel()))], ["node", "subs"])

    return code


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the symmetric matrix ``linked`` connects."""
    a, b, rest = [], [], np.flatnonzero(linked.any(axis=1))
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = linked[at, rest]
            if near.any():
                found = rest[near].tolist()
                a += [at] * len(found)
                b += found
                stack += found
                rest = rest[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def block(t: int, part: np.ndarray, i: int, j: int, n: np.ndarray, subs: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each node, edges a, edges b) among nodes that meet in table ``t`` and in no earlier one: those of part i against part j."""
    x = unit(vectors)
    near = x @ x.T >= COSINE
    if i != j:
        near &= part[:, None] != part[None, :]
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    if t and len(a):
        old = np.zeros(len(a), bool)
        for k in range(t):
            old |= subs[a, k] == subs[b, k]
        near[a[old], b[old]] = False
        a, b = a[~old], b[~old]
    sums = np.zeros(len(n), np.int64)
    np.add.at(sums, a, n[b])
    return sums, *forest(near)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> (node, links, null) and (a, null, b). Only the block under way is held."""

    def blocks():
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([now.column(c).to_numpy() for c in ("gid", "tag", "dims")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            for at, to in itertools.pairwise(cuts):
                yield now.slice(at, to - at)
            held = now.slice(cuts[-1])
        if held is not None:
            yield held

    out: list[list[np.ndarray]] = [[], [], [], []]

    def told():
        nodes, sums, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        none = [pa.nulls(len(x), pa.int64()) for x in (nodes, a)]
        for x in out:
            x.clear()
        yield pa.record_batch([pa.array(nodes), pa.array(sums), none[0]], ["node", "links", "other"])
        yield pa.record_batch([pa.array(a), none[1], pa.array(b)], ["node", "links", "other"])

    for g in blocks():
        if g.num_rows < 2:
            continue
        g = g.combine_chunks()
        first = {c: g.column(c)[0].as_py() for c in ("t", "i", "j", "dims")}
        subs = g.column("subs").combine_chunks()
        sums, a, b = block(first["t"], g.column("part").to_numpy(), first["i"], first["j"], g.column("n").to_numpy(), subs.flatten().to_numpy().reshape(g.num_rows, -1), unpack(g.column("vec").to_pylist(), first["dims"]))
        nodes, some = g.column("node").to_numpy(), np.flatnonzero(sums)
        for x, y in zip(out, (nodes[some], sums[some], nodes[a], nodes[b]), strict=True):
            x.append(y)
        if sum(map(len, out[0])) > 50_000:
            yield from told()
    yield from told()


def _links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, links, other): sums of links where other is null, else edges that connect all linked nodes. ``nodes``: written."""
    sizes = nodes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(FITTED).collect()
    most = nodes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    bits, count = tables(most)
    models = {}
    for d, _ in sizes:  # digests are as good as random
        sample = nodes.where(F.col("dims") == d).orderBy("digest").limit(SAMPLE).select("vec").collect()
        models[d] = rotations(unit(unpack([r[0] for r in sample], d)), d, bits * count)
    codes = scratch.save(nodes.select("node", "dims", "vec").mapInArrow(_coder(models, bits, count), "node long, subs array<int>"), "codes")
    named = codes.join(nodes.select("node", "label", "dims"), "node").select("node", "label", "dims", F.posexplode("subs").alias("t", "sub"))
    bucket = [F.col(c) for c in ("t", "label", "dims", "sub")]
    keyed = scratch.save(named.select("node", "t", F.xxhash64(*bucket).alias("key"), F.hash(*bucket).alias("tag")), "keyed")
    met = scratch.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "met")
    there = scratch.save(join_hot(keyed, met, "key", hot_keys(met, "key", "size")), "there")
    full = codes.join(nodes.select("node", "n", "dims", "vec"), "node")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = there.join(full, "node").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with"))
    rows = dealt.select(F.xxhash64("key", "i", "j").alias("gid"), "tag", "dims", "t", "part", "i", "j", "node", "n", "subs", "vec")
    return rows.repartition("gid").sortWithinPartitions("gid", "tag", "dims").mapInArrow(_compare, "node long, links long, other long")


def classes(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    small_batches(spark)
    scratch = Scratch(spark, "embeddings")
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = scratch.save(source.mapInArrow(_pack, "vec_id long, label string, dims int, digest binary, vec binary"), "rows")
    linkable = rows.where("digest is not null")
    best = F.min(F.struct(F.col("vec_id").isNull().alias("unnamed"), "vec_id"))
    folded = linkable.groupBy("digest").agg(F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), best.alias("best"))
    nodes = scratch.save(folded.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = scratch.save(_links(nodes, scratch), "links")
    sums = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.select("node", "digest", "n", "best").join(sums, "node", "left").select("node", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "best")
    edges = scratch.save(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "edges")
    if edges.limit(1).count():
        roots = components(edges, scratch)
        linked = scratch.save(told.join(roots, "node"), "linked")
        heads = linked.groupBy("root").agg(F.min("best").alias("head"))
        whole = join_hot(linked, heads, "root", hot_keys(linked, "root")).select("digest", "n_links", F.col("head").alias("best"))
        told = told.join(roots, "node", "left_anti").select("digest", "n_links", "best").unionByName(whole)
    told = scratch.save(told.select("digest", "n_links", F.col("best.vec_id").alias("component_id")), "told")
    scratch.keep("rows", "told")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    named = join_hot(linkable.select("vec_id", "digest"), told, "digest", hot_keys(linkable, "digest")).select("vec_id", "n_links", "component_id")
    return named.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
