"""Approximate nearest neighbours by cosine: coarse cells, product-quantised residuals, exact re-ranking.

``build`` fits everything on a bounded sample: cells by spherical k-means, and for each run of dimensions 256 centres of what
is left behind the cell's centre. Every row is then stored by cell, with a code of a byte per run in one column and its vector in another. A
search sends each query to its nearest cells, scores the codes there by table lookup, and reads the vectors of the ``rerank``
best rows alone, which are ranked by their exact cosine. How many cells a query visits is chosen at the fit, as the fewest that
give the wanted recall on queries of the sample.

Cells are dealt into ``SHARDS``; a query goes once to each shard where it visits cells, and a shard emits the ``rerank`` best of all
these cells, so what is shuffled grows with the queries, not with the cells that they visit. Shards and their queries are
dealt in parts of bounded size, so neither a large cell nor a cell that all queries visit meets in one task. Vectors that are null, empty, zero, not
finite or of another length than most are not indexed and have no neighbours.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import vector

#: Rows of the sample, rounds of k-means, cells at most, dimensions of a run.
SAMPLE, ROUNDS, MOST_CELLS, RUN = 20_000, 12, 4096, 4
#: Shards of the cells, rows of a part of a shard, queries of a part, queries that are scored at once.
SHARDS, PART_ROWS, PART_QUERIES, SLICE = 24, 65_536, 16_384, 256
#: Queries of the sample by which the number of visited cells is chosen, how many neighbours of each, and the recall to reach.
TRIALS, NEAR, RECALL = 64, 50, 0.98
#: Probed cells that are named to the scan.
NAMED = 1000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, by distance, in slices."""
    norms = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - norms).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


class Model:
    """Centres of the cells and of the runs' residuals; how many cells a query visits."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray], probes: int):
        self.centres, self.books, self.probes = centres, books, probes
        self.dims = centres.shape[1]
        self.cuts = [slice(i, min(i + RUN, self.dims)) for i in range(0, self.dims, RUN)]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        sample = unit(sample)
        centres = _kmeans(sample, max(1, min(MOST_CELLS, len(sample), math.isqrt(rows))), rng)
        rest = sample - centres[_nearest(sample, centres)]
        books = [_kmeans(np.ascontiguousarray(rest[:, i : i + RUN]), 256, rng) for i in range(0, sample.shape[1], RUN)]
        model = cls(centres, books, len(centres))
        trials = sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)]
        cells, order = _nearest(sample, centres), np.argsort(-(trials @ centres.T), axis=1)
        near = np.argsort(-(trials @ sample.T), axis=1)[:, : min(NEAR, len(sample))]
        rank = np.argsort(order, axis=1)
        needed = np.sort(np.concatenate([r[cells[n]] for r, n in zip(rank, near, strict=True)]))
        model.probes = int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)) - 1)]) + 1
        return model

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, a byte per run) of each row."""
        x = unit(x)
        cells = _nearest(x, self.centres)
        rest = x - self.centres[cells]
        return cells, np.stack([_nearest(np.ascontiguousarray(rest[:, c]), b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def visited(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosine of each query with each coded row of a cell."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for i, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, c] @ book.T)[:, codes[:, i]]
        return out

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, centres=self.centres, probes=self.probes, **{f"book{i}": b for i, b in enumerate(self.books)})
        return held.getvalue()

    @classmethod
    def load(cls, held: bytes) -> Model:
        x = np.load(io.BytesIO(held))
        return cls(x["centres"], [x[f"book{i}"] for i in range(sum(n.startswith("book") for n in x.files))], int(x["probes"]))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(column: str, dims: int | None = None) -> Column:
    """Whether a vector has a direction (and the length)."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & finite & (F.size(v) == dims if dims is not None else F.size(v) > 0)


class VectorIndex:
    """A stored index: codes and vectors by cell, the model, and the number of rows of each cell."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark = spark
        rows = spark.read.schema(f"cell int, id {id_type}, code binary, vector array<double>").parquet(f"{path}/rows")
        self.codes, self.vectors = rows.select("cell", "id", "code"), rows.select("cell", "id", "vector")
        self.cells = spark.read.schema("cell int, rows long").parquet(f"{path}/cells")
        self.model = Model.load(spark.read.schema("held binary").parquet(f"{path}/model").first()[0])

    def search(self, queries: DataFrame, k: int, rerank: int | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, id, cosine, rank): the ``k`` nearest rows of each of ``queries`` (query_id, vector) among its ``rerank`` candidates."""
        model, rerank = self.model, rerank or 4 * k
        probes = min(len(model.centres), probes or model.probes)
        asked = queries.where(usable("vector", model.dims)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        query_type = dict(queries.dtypes)["query_id"]
        seen = asked.mapInArrow(_visits(model, probes), f"query_id {query_type}, vector array<double>, shard int, cells array<int>")
        few = seen.select(F.explode("cells").alias("cell")).distinct().limit(NAMED + 1).collect()
        near = lambda df: df.where(F.col("cell").isin([r.cell for r in few])) if len(few) <= NAMED else df
        shard = F.pmod(F.col("cell"), F.lit(SHARDS)).alias("shard")
        sizes = near(self.cells).groupBy(shard).agg(F.sum("rows").alias("rows"))
        loads = seen.groupBy("shard").agg(F.count(F.lit(1)).alias("queries")).join(sizes, "shard")
        dealt = loads.select("shard", F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts"), F.ceil(F.col("queries") / PART_QUERIES).cast("int").alias("groups"))
        dealt = F.broadcast(dealt.limit(SHARDS))
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
        share = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        rows = near(self.codes).withColumn("shard", shard).join(dealt, "shard").select("shard", share("id", "parts").alias("part"), every("groups", "group"), "cell", "id", "code")
        visits = seen.join(dealt, "shard").select("shard", every("parts", "part"), share("query_id", "groups").alias("group"), "query_id", "vector", "cells")
        key = ["shard", "part", "group"]
        best = rows.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_score(model, rerank), f"query_id {query_type}, cell int, id {dict(self.codes.dtypes)['id']}, estimate double")
        order = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "id")
        short = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rerank).select("query_id", "cell", "id").distinct()
        told = near(self.vectors).join(short, ["cell", "id"]).join(asked.withColumnRenamed("vector", "asked"), "query_id")
        last = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
        return told.select("query_id", "id", vector.cosine(F.col("vector"), F.col("asked")).alias("cosine")).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def _visits(model: Model, probes: int):
    """A row for each query and shard, with the cells of the shard that the query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = model.visited(unit(_matrix(b.column(1), model.dims)), probes).astype(np.int32)
                keys = (np.arange(b.num_rows)[:, None] * SHARDS + cells % SHARDS).ravel()
                order = np.argsort(keys, kind="stable")
                told, starts = np.unique(keys[order], return_index=True)
                at = pa.array(told // SHARDS)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(cells.ravel()[order]))
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array((told % SHARDS).astype(np.int32)), lists], ["query_id", "vector", "shard", "cells"])

    return run


def _score(model: Model, most: int):
    """The best rows of a part of a shard for each query that visits it, from all its visited cells there."""

    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        if not rows.num_rows or not visits.num_rows:
            return pa.table({"query_id": visits.column("query_id").slice(0, 0), "cell": rows.column("cell").slice(0, 0), "id": rows.column("id").slice(0, 0), "estimate": pa.array([], pa.float64())})
        rows = rows.sort_by("cell")
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        cells, starts = np.unique(rows.column("cell").to_numpy(), return_index=True)
        q, lists = unit(_matrix(visits.column("vector").combine_chunks(), model.dims)), visits.column("cells").combine_chunks()
        asked, which = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        order = np.argsort(asked, kind="stable")
        asked, which = asked[order], which[order]
        n = min(most, rows.num_rows)
        best, at = np.full((len(q), n), -np.inf), np.full((len(q), n), -1)
        for cell, lo, hi in zip(cells, starts, np.append(starts[1:], rows.num_rows), strict=True):
            visiting = which[np.searchsorted(asked, cell) : np.searchsorted(asked, cell, "right")]
            for i in range(0, len(visiting), SLICE):
                some = visiting[i : i + SLICE]
                scores = np.concatenate([best[some], model.scores(q[some], cell, codes[lo:hi])], axis=1)
                places = np.concatenate([at[some], np.broadcast_to(np.arange(lo, hi), (len(some), hi - lo))], axis=1)
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                best[some], at[some] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(places, top, axis=1)
        query, place = np.nonzero(at >= 0)
        held = rows.select(["cell", "id"]).take(pa.array(at[query, place]))
        return pa.table({"query_id": visits.column("query_id").take(pa.array(query)), "cell": held.column("cell"), "id": held.column("id"), "estimate": best[query, place]})

    return run


def _coder(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells, codes = model.code(_matrix(b.column(1), model.dims))
                yield pa.record_batch([pa.array(cells.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], ["cell", "id", "code", "vector"])

    return run


def build(spark: SparkSession, rows: DataFrame, path: str) -> VectorIndex:
    """Write the index of ``rows`` (id, vector) to ``path``."""
    some = rows.where(usable("vector")).select("id", F.col("vector").cast("array<double>").alias("vector"))
    lengths = some.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        raise ValueError("no vector to index")
    dims, n = lengths
    some = some.where(F.size("vector") == dims)
    sample = some.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).select("vector").collect()
    model = Model.fit(np.array([r[0] for r in sample]), n)
    id_type = dict(rows.dtypes)["id"]
    coded = some.mapInArrow(_coder(model), f"cell int, id {id_type}, code binary, vector array<double>")
    write = lambda df, name: df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    write(coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "rows")
    held = spark.read.schema(f"cell int, id {id_type}, code binary, vector array<double>").parquet(f"{path}/rows")
    write(held.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")), "cells")
    write(spark.createDataFrame([(bytearray(model.dump()),)], "held binary"), "model")
    return VectorIndex(spark, path, id_type)
