"""Quality rules: base counts of each text, then a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hash buckets of byte ``GRAM``-grams are estimated: the raw corpus from every document,
the trusted target from labelled good documents. A document's score is the mean over its grams of
log p_target - log p_raw; it is kept when its base rules hold and the score is at least ``THRESHOLD``.

Defined results: a null text counts as empty (no words, base fails); a text shorter than a gram scores 0; without trusted
documents every score is 0 and the base rules decide; repeated rows and ids are judged row by row; other columns are
not read (or, in ``keep_good``, pass through unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import raw, small_batches

GRAM, BUCKET_BITS, THRESHOLD = 4, 16, -0.3
BUCKETS = 1 << BUCKET_BITS
#: Bound of the labelled sample that the trusted multinomial is fitted on (those with the smallest id hashes).
TRUSTED_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_CLASS = np.zeros(256, np.uint8)  # 0: in a word, 1: continuation byte, 2: white space, 3: symbol
_CLASS[0x80:0xC0] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 2
_CLASS[list(b"#*$%&|<>")] = 3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: list[bytes]) -> int:
    """Words covered by ``WINDOW``-word windows that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    bits = max(1, len(seen).bit_length())
    if bits * WINDOW <= 64:
        key = ids[:n].copy()
        for i in range(1, WINDOW):
            key = (key << np.uint64(bits)) | ids[i : n + i]
    else:  # too many distinct words to pack five: pack step by step, by rank
        key = ids[:n]
        for i in range(1, WINDOW):
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64) << np.uint64(32) | ids[i : n + i]
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=4)
    dup = 0
    if b"\n" in text:
        earlier: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in earlier:
                dup += 1
            elif line.strip():
                earlier.add(line)
    return len(words), int(kinds[0] + kinds[3]), int(kinds[3]), dup, _repeat_words(words)


def grams(text: bytes) -> np.ndarray:
    """Hash buckets of the text's byte n-grams, repeats included."""
    b = np.frombuffer(text, np.uint8)
    n = len(b) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = b[:n].astype(np.uint32)
    for i in range(1, GRAM):
        h <<= np.uint32(8)
        h |= b[i : n + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, trusted in zip(raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            c = np.bincount(grams(text), minlength=BUCKETS)
            counts[0] += c
            if trusted:
                counts[1] += c
    used = np.flatnonzero(counts[0])
    if len(used):
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "n_raw", "n_target"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw for each bucket; at most ``BUCKETS`` rows reach the driver."""
    small_batches(spark)
    trusted = (
        labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__trusted")).agg(F.min("quality").alias("q")).where("q = 1")
        .orderBy(F.xxhash64("__trusted"), "__trusted").limit(TRUSTED_ROWS).select("__trusted")
    )
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("__trusted"), "left").select("text", F.col("__trusted").isNotNull().alias("trusted"))
    rows = marked.mapInArrow(_count, "bucket int, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[:, rows.bucket.to_numpy(np.int64)] = rows[["n_raw", "n_target"]].to_numpy(float).T
    if not counts[1].any():
        return np.zeros(BUCKETS)
    log_p = np.log(counts + 1) - np.log(counts.sum(axis=1, keepdims=True) + BUCKETS)
    return log_p[1] - log_p[0]


def verdict(text: bytes, ratios: np.ndarray) -> tuple:
    """The base counts, base_failed, score and kept."""
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    h = grams(text)
    score = float(ratios[h].sum() / len(h)) if len(h) else 0.0
    return *counts, failed, score, not failed and score >= THRESHOLD


def judge(spark: SparkSession, docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            rows = [verdict(t, shared.value) for t in raw(batch.column(1))]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *BASE, "base_failed", "score", "kept"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, score double, kept boolean")
    return out.select("doc_id", *BASE, "base_failed", "kept", "score")


def keep_good(spark: SparkSession, docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """The documents that pass, with all their columns; one pass and no join."""
    small_batches(spark)
    shared, at = spark.sparkContext.broadcast(ratios), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([verdict(t, shared.value)[-1] for t in raw(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
