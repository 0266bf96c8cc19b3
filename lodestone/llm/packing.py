"""Packing into length buckets whose boundaries a dynamic program sets, then token-budget batches inside each bucket.

The global histogram of lengths is exact. It has one row per distinct length, and m distinct lengths take at least m^2 / 2
tokens, so it grows with the square root of the corpus at most (some six million rows at 10^13 tokens, which would all have
to be documents of their own length). The program minimises the padding of all documents over at most ``BUCKETS`` buckets.
Places inside a bucket are dealt in two steps (by shard of hashed rows, then by the shards' counts), so no task ever sees a
whole bucket.

Length: words (runs outside ASCII white space) plus one end token. A document longer than ``BUDGET`` gets a batch of its own.

Defined results: a null text counts as empty (length 1); null and repeated ids each keep their row and are dealt by their text
as well; equal ids order by length, then by text hash; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, text_hash, whole

BUCKETS, BUDGET = 16, 65_536
#: Documents in a shard of a bucket, on average at most; and the least number of shards.
SHARD_ROWS, MIN_SHARDS = 1 << 16, 64


def length(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")) + 1).cast("long")


def _cheapest(best: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least of best[i] + lengths[j - 1] * (before[j] - before[i]) over i < j, and its i.

    The cost is Monge, so the best i moves one way with j: the middles of all open spans are solved at once, each between the
    cuts of its span's ends, and every round halves the spans.
    """
    m = len(lengths)
    cost, cut = best.copy(), np.arange(m + 1)
    lo, hi, first, last = (np.array([x]) for x in (1, m, 0, m))
    while len(lo):
        j = (lo + hi) // 2
        sizes = np.minimum(last, j - 1) - first + 1
        ends = np.cumsum(sizes)
        i = np.arange(ends[-1]) - np.repeat(ends - sizes - first, sizes)
        at = np.repeat(j, sizes)
        values = best[i] + lengths[at - 1] * (before[at] - before[i])
        least = np.minimum.reduceat(values, ends - sizes)
        where = np.where(values == np.repeat(least, sizes), i, m)
        cost[j], cut[j] = least, np.minimum.reduceat(where, ends - sizes)
        lo, hi, first, last = np.concatenate([lo, j + 1]), np.concatenate([j - 1, hi]), np.concatenate([first, cut[j]]), np.concatenate([cut[j], last])
        open_ = lo <= hi
        lo, hi, first, last = lo[open_], hi[open_], first[open_], last[open_]
    return cost, cut


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding; layer k holds the least padded size in k buckets."""
    m = len(lengths)
    if not m:
        return []
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        new, cut = _cheapest(best, lengths, before)
        if new[m] >= best[m]:
            break
        cuts.append(cut)
        best = new
    out, j = [], m
    for cut in reversed(cuts):
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
        if not j:
            break
    return out[::-1]


def pack(spark: SparkSession, docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, padded_tokens, batch_id (within all), slot (within the batch)."""
    scratch = Scratch(spark, "packing")
    rows = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), length(whole()).alias("n_tokens"), text_hash().alias("h")), "rows")
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("n_tokens")
    bounds = boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)
    shards = max(MIN_SHARDS, -(-int(histogram["n"].sum()) // SHARD_ROWS))
    uppers = F.array(*[F.lit(b).cast("long") for b in bounds or [1]])
    bucket = F.size(F.filter(uppers, lambda b: b < F.col("n_tokens")))
    dealt = rows.select("doc_id", "n_tokens", "h", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id", "n_tokens", "h"), F.lit(shards)).alias("shard"))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.element_at(uppers, F.col("bucket") + 1))).cast("long")
    # shards x buckets rows: bounded by the rows over SHARD_ROWS
    counts = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("batches", F.ceil(F.col("n") / per)).collect()
    first, offsets = 0, {}
    for t in sorted(totals, key=lambda t: t["bucket"]):
        offsets[t["bucket"]], first = first, first + t["batches"]
    offset = F.element_at(F.array(*[F.lit(offsets.get(b, 0)).cast("long") for b in range(max(1, len(bounds)))]), F.col("bucket") + 1)
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "h")) - 1
    ranked = dealt.withColumn("place", place).join(scratch.save(starts, "starts"), ["bucket", "shard"]).withColumn("place", F.col("place") + F.col("ahead"))
    return ranked.select("doc_id", "n_tokens", "bucket", F.element_at(uppers, F.col("bucket") + 1).alias("padded_tokens"), (offset + F.floor(F.col("place") / per)).alias("batch_id"), (F.col("place") % per).alias("slot"))
