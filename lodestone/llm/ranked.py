"""Ranked lexical search over a two-level quantised index.

A document's score for a query is the sum over the query's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 12 m)),
with w from the number of documents that hold the term and m from the document's length. The index is cut by documents:
each block holds up to ``BLOCK_DOCS`` of them with the postings of all their terms. A posting has two levels: its impact in
one byte, rounded upward, and its exact term frequency.

A search sends its terms with their weights to the blocks. In a block the bytes alone give each document an upper and a lower
bound per query; every document whose upper bound reaches the kth largest lower bound, or the kth best score known in the
task, is scored again in exact integers, and only the k best of the task leave it. So no posting list is shuffled, no list
meets in one task, and a hot term costs each block its own part. Queries come in slices of bounded size; documents are never cut.

Defined results: a null or empty text has no terms, is never found and is not counted; a query without terms has no rows;
rows that repeat an id are documents, or queries, of their own; a null doc_id sorts last among equal scores; an empty table on
either side gives an empty result; other columns are not read. Weights are taken from the whole index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, bounded, raw, small_batches
from lodestone.llm.tokens import _Numbers, ragged

#: Documents and bytes of text of one block; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
#: Queries that go to the blocks together, and their terms at most (a longer query goes alone).
SLICE, SLICE_TERMS = 256, 20_000
#: What maps A-Z to a-z and everything that is no term to a blank; the largest impact.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TOP = 1_000_000
#: Bounds of an impact by its byte: greatest and least.
UPPER = np.arange(256, dtype=np.int64) * TOP // 255
LOWER = np.array([0, *(UPPER[:-1] + 1)], np.int64)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms with repeats."""
    docs = total = 0
    for b in batches:
        for t in raw(b.column(0)):
            line = np.frombuffer(t.translate(_TABLE) + b" ", np.uint8) != 32
            n = int((line[:-1] & ~line[1:]).sum())
            docs, total = docs + (n > 0), total + n
    yield pa.record_batch([pa.array([docs]), pa.array([total])], ["docs", "terms"])


_BLOCK = "docs array<long>, m binary, term binary, df binary, doc binary, tf binary, impact binary"


def _block(ids: list, texts: list[bytes], docs: int, total: int) -> pa.RecordBatch | None:
    """One block; postings by term in the order of ``term``, each list by document."""
    words = [terms(t) for t in texts]
    kept = [i for i, w in enumerate(words) if w]
    if not kept:
        return None
    numbers = _Numbers()
    sizes = np.array([len(words[i]) for i in kept], np.int64)
    at = np.fromiter((numbers[w] for i in kept for w in words[i]), np.int64, int(sizes.sum()))
    key, tf = np.unique(at * len(kept) + np.repeat(np.arange(len(kept)), sizes), return_counts=True)
    term, doc = key // len(kept), key % len(kept)
    m = np.array([75 + 25 * n * docs // total for n in sizes.tolist()], np.int64)
    level = (impact(tf, m[doc]) * 255 + TOP - 1) // TOP
    cells = [m.tobytes(), b" ".join(numbers), np.bincount(term).astype(np.int32).tobytes(), doc.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes(), level.astype(np.uint8).tobytes()]
    columns = [pa.array([[ids[i] for i in kept]], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in cells)]
    return pa.record_batch(columns, ["docs", "m", "term", "df", "doc", "tf", "impact"])


def _indexer(docs: int, total: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def cut():
            if (made := _block(ids, texts, docs, total)) is not None:
                yield made
            ids.clear()
            texts.clear()

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                if ids and (len(ids) == BLOCK_DOCS or held + len(t) > BLOCK_BYTES):
                    yield from cut()
                    held = 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        yield from cut()

    return index


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the number of their documents, summed over the task's blocks as far as memory allows."""
    seen: Counter = Counter()

    def told():
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])
        seen.clear()

    for b in batches:
        for words, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w, n in zip(words.split(b" "), np.frombuffer(df, np.int32).tolist(), strict=True):
                seen[w] += n
            if len(seen) > 200_000:
                yield from told()
    yield from told()


class Index:
    """A written index: its blocks, the documents that hold each term, the number of documents."""

    def __init__(self, spark: SparkSession, path: str, docs: int):
        self.blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
        self.vocabulary = spark.read.schema("term binary, df long").parquet(f"{path}/vocabulary")
        self.docs = docs


def build(spark: SparkSession, documents: DataFrame, path: str) -> Index:
    """Write the index of ``documents`` (doc_id, text) to ``path``: a count of terms, the blocks, the vocabulary."""
    small_batches(spark)
    docs, total = documents.select("text").mapInArrow(_measure, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source.mapInArrow(_indexer(docs, total), _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    held = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("term", "df").mapInArrow(_vocabulary, "term binary, df long")
    held.groupBy("term").agg(F.sum("df").alias("df")).write.option("compression", "zstd").parquet(f"{path}/vocabulary")
    return Index(spark, path, docs)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _best(scores: np.ndarray, ids: np.ndarray, named: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~named, -scores))[:k]


class Searcher:
    """Scores blocks for a slice of queries: ``queries`` has each one's (term, weight times repeats)."""

    def __init__(self, queries: list[list[tuple[bytes, int]]], k: int):
        self.k = k
        self.terms = {t: i for i, t in enumerate({t for q in queries for t, _ in q})}
        self.queries = [(np.array([self.terms[t] for t, _ in q], np.int64), np.array([w for _, w in q], np.int64)) for q in queries]
        by: list[list[tuple[int, int]]] = [[] for _ in self.terms]
        for at, q in enumerate(queries):
            for t, w in q:
                by[self.terms[t]].append((at, w))
        self.asked = [(np.array([a for a, _ in x], np.int64), np.array([w for _, w in x], np.int64)) for x in by]
        none = np.zeros(0, np.int64)
        self.found = [(none, none, none.astype(bool)) for _ in queries]

    def floor(self, q: int) -> int:
        scores = self.found[q][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def look(self, block: dict) -> None:
        docs = block["docs"]
        named = np.array([d is not None for d in docs])
        ids = np.array([0 if d is None else d for d in docs], np.int64)
        m, df, doc, tf, level = (np.frombuffer(block[c], t) for c, t in (("m", np.int64), ("df", np.int32), ("doc", np.int32), ("tf", np.int32), ("impact", np.uint8)))
        ends = np.cumsum(df, dtype=np.int64)
        held = {at: (int(e) - int(n), int(e)) for t, e, n in zip(block["term"].split(b" "), ends, df, strict=True) if (at := self.terms.get(t)) is not None}
        high = np.zeros((len(self.queries), len(docs)), np.int64)
        low = np.zeros_like(high)
        for at, (i, j) in held.items():
            rows, weights = self.asked[at]
            for bound, impacts in ((high, UPPER), (low, LOWER)):
                bound[rows[:, None], doc[i:j]] += weights[:, None] * impacts[level[i:j]]
        for q, (asked, weights) in enumerate(self.queries):
            reach = self.floor(q)
            if len(docs) > self.k:
                reach = max(reach, int(np.partition(low[q], -self.k)[-self.k]))
            near = np.flatnonzero(high[q] >= reach)
            if not len(near):
                continue
            exact = np.zeros(len(near), np.int64)
            for at, w in zip(asked.tolist(), weights.tolist(), strict=True):
                if (span := held.get(at)) is None:
                    continue
                own = doc[slice(*span)]
                place = np.minimum(np.searchsorted(own, near), len(own) - 1)
                hit = own[place] == near
                exact[hit] += w * impact(tf[slice(*span)][place[hit]].astype(np.int64), m[near[hit]])
            near, exact = near[exact > 0], exact[exact > 0]
            joined = [np.concatenate(x) for x in zip(self.found[q], (exact, ids[near], named[near]), strict=True)]
            best = _best(*joined, self.k)
            self.found[q] = tuple(x[best] for x in joined)


def _search(queries: list[list[tuple[bytes, int]]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Searcher(queries, k)
        for b in batches:
            for i in range(b.num_rows):
                s.look({c: b.column(c)[i].as_py() for c in b.schema.names})
        sizes = [len(f[0]) for f in s.found]
        scores, ids, named = (np.concatenate([f[c] for f in s.found]) for c in range(3))
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(ids, mask=~named), pa.array(scores)], ["query", "doc_id", "score"])

    return run


def _slices(asked: DataFrame) -> list[tuple[int, int]]:
    """Runs [from, to] of query numbers, each of bounded size, from the queries' numbers of terms in ranges of ``SLICE``."""
    rows = asked.groupBy((F.col("number") / SLICE).cast("long").alias("range")).agg(F.min("number").alias("a"), F.max("number").alias("b"), F.sum("n").alias("n")).orderBy("range").collect()
    out = []
    for r in rows:
        step = max(1, (r.b - r.a + 1) // max(1, -(-r.n // SLICE_TERMS)))
        out += [(i, min(i + step - 1, r.b)) for i in range(r.a, r.b + 1, step)]
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for number, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
            held = Counter(terms(t))
            yield pa.record_batch([pa.array([number] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["number", "term", "times"])


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """Per query (item_id, text) its ``k`` best documents: item_id, rank, doc_id, score."""
    small_batches(spark)
    scratch = Scratch(spark, "ranked")
    items = scratch.save(queries.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "items")
    ranks = items.withColumn("part", F.shiftright("number", 33))
    sizes = ranks.groupBy("part").count().orderBy("part").collect()  # a row for each file of the written table
    starts, total = {}, 0
    for r in sizes:
        starts[r.part], total = total, total + r["count"]
    start = F.create_map(*[F.lit(x) for p in starts.items() for x in p])[F.col("part")] if starts else F.lit(0)
    items = scratch.save(ranks.select("item_id", "text", (F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) + start).cast("long").alias("number")), "numbered")
    asked = scratch.save(items.select("number", "text").mapInArrow(_terms, "number long, term binary, times long"), "asked")
    known = index.vocabulary.join(bounded(asked.select("term").distinct()), "term")
    weighed = scratch.save(asked.join(known, "term"), "weighed")
    slices = _slices(weighed.groupBy("number").agg(F.count(F.lit(1)).alias("n")))
    found = []
    for a, b in slices:
        rows = weighed.where(F.col("number").between(a, b)).collect()  # one slice: SLICE queries, SLICE_TERMS terms or one query
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r.number, []).append((bytes(r.term), r.times * weight(index.docs, r.df)))
        if not by:
            continue
        numbers = sorted(by)
        hits = index.blocks.mapInArrow(_search([by[n] for n in numbers], k), "query int, doc_id long, score long")
        named = F.array(*[F.lit(n) for n in numbers])[F.col("query")]
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        kept = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(scratch.save(kept.select(named.alias("number"), "rank", "doc_id", "score"), f"found{len(found)}"))
    scratch.keep("numbered", *[f"found{i}" for i in range(len(found))])
    if not found:
        return items.limit(0).selectExpr("item_id", "0 as rank", "0L as doc_id", "0L as score")
    told = spark.read.schema(found[0].schema).parquet(*[scratch.path(f"found{i}") for i in range(len(found))])
    return told.join(bounded(items.select("number", "item_id")), "number").select("item_id", "rank", "doc_id", "score")
