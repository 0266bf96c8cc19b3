"""Length buckets against an exhaustive search, batches against their contract."""

import itertools
import re

import numpy as np

from lodestone.llm import packing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def padded(bounds, lengths, counts):
    return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = np.sort(rng.choice(200, rng.integers(1, 11), replace=False) + 1)
        counts = rng.integers(1, 50, len(lengths))
        k = int(rng.integers(1, 5))
        got = packing.boundaries(lengths, counts, k)
        assert len(got) <= k and got[-1] == lengths[-1]
        best = min(padded((*c, lengths[-1]), lengths, counts) for r in range(k) for c in itertools.combinations(lengths[:-1].tolist(), r))
        assert padded(got, lengths, counts) == best


def test_batches(spark, odd, documents, empty):
    assert packing.pack(spark, empty).count() == 0
    for docs in (odd, documents):
        out = packing.pack(spark, docs, buckets=5, budget=2000).toPandas()
        want = sorted(len(WORDS.findall(r.text or "")) + 1 for r in docs.collect())
        assert sorted(out.n_tokens) == want and (out.padded_tokens >= out.n_tokens).all()
        size = out.groupby("batch_id").agg(n=("slot", "size"), last=("slot", "max"), pad=("padded_tokens", "max"), kinds=("bucket", "nunique"))
        assert (size.kinds == 1).all() and (size["last"] == size.n - 1).all()
        assert ((size.n == 1) | (size.n * size["pad"] <= 2000)).all()
        assert sorted(size.index) == list(range(len(size)))
        full = out.groupby("bucket").batch_id.nunique()
        rows = out.groupby("bucket").agg(n=("slot", "size"), pad=("padded_tokens", "max"))
        assert (full == np.ceil(rows.n / np.maximum(1, 2000 // rows["pad"]))).all()


def test_boundaries_of_a_wide_histogram():
    """Against the quadratic program, on many lengths and without a bound on them."""
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 10**7, 400))
    counts = rng.integers(1, 1000, len(lengths))
    before, m = np.concatenate([[0], np.cumsum(counts)]), len(lengths)
    best = [0.0] + [float("inf")] * m
    for _ in range(6):
        best = [0.0] + [min(best[j], *(best[i] + lengths[j - 1] * (before[j] - before[i]) for i in range(j))) for j in range(1, m + 1)]
    assert padded(packing.boundaries(lengths, counts, 6), lengths, counts) == best[m]


def test_null_and_repeated_ids_are_dealt_by_text(spark, monkeypatch):
    monkeypatch.setattr(packing, "MIN_SHARDS", 8)
    docs = spark.createDataFrame([(None if i % 2 else 7, f"word{i}") for i in range(400)], "doc_id long, text string")
    out = packing.pack(spark, docs, budget=20).toPandas()
    assert len(out) == 400 and out.groupby("batch_id").size().max() <= 10 and not out.duplicated(["batch_id", "slot"]).any()
