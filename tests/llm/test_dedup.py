"""Exact and near deduplication against brute force."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone.llm import common, exact, simhash
from lodestone.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_exact_classes(spark, name, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, (r.text or "").translate(FOLD)) for r in docs.collect()]
    members = defaultdict(list)
    for i, t in rows:
        members[t].append(i)
    best = {t: max((i for i in m if i is not None), default=None) for t, m in members.items()}
    want = sorted((str(i), str(best[t]), len(members[t]), i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((str(a), str(b), *c) for a, b, *c in exact.classes(spark, docs).collect()) == want


def test_exact_keeps_columns_and_empty(spark, odd, empty):
    kept = exact.drop_duplicates(spark, odd)
    assert kept.columns == odd.columns and kept.where("text = 'no id here'").count() == 1
    assert exact.classes(spark, empty).count() == 0


def test_exact_drops_rows_not_ids(spark):
    """An id on two texts, of which one is superseded; null ids lose to any other, and are told apart by nothing."""
    rows = [(1, "same"), (2, "SAME"), (1, "alone"), (None, "same"), (None, "mine"), (None, "mine"), (None, "two"), (3, "Two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, exact.drop_duplicates(spark, docs).collect())) == sorted(map(str, spark.createDataFrame([(2, "SAME"), (1, "alone"), (None, "mine"), (None, "mine"), (3, "Two")], docs.schema).collect()))


def test_exact_classes_do_not_depend_on_the_snapshot(spark, odd):
    want = sorted(map(str, exact.classes(spark, odd).collect()))
    for split in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") < 12, F.lit(False)), F.col("text").isNull()):
        assert sorted(map(str, exact.classes(spark, odd, split).collect())) == want


def test_snapshot_serves_a_second_batch(spark, odd, tmp_path):
    old, new = odd.where("doc_id < 9"), odd.where("doc_id >= 9 or doc_id is null")
    path = str(tmp_path / "snapshot")
    exact.take_snapshot(spark, exact.digests(old, F.lit(True)), path)
    want = exact.classes(spark, odd, F.coalesce(F.col("doc_id") < 9, F.lit(False))).where("doc_id >= 9 or doc_id is null")
    for _ in range(2):
        got = exact.against(spark, exact.Snapshot(spark, path), old, new)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(AnalysisException):
        exact.take_snapshot(spark, exact.digests(old, F.lit(True)), path)


def test_hot_keys_change_nothing(spark, odd, monkeypatch):
    """Every key that repeats counts as hot, so all joins take the split way."""
    plain = [sorted(map(str, f(spark, odd).collect())) for f in (exact.classes, simhash.classes, exact.drop_duplicates, simhash.keep_one)]
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    hot = [sorted(map(str, f(spark, odd).collect())) for f in (exact.classes, simhash.classes, exact.drop_duplicates, simhash.keep_one)]
    assert hot == plain


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    side = spark.range(100).select("id", F.repeat(F.lit("x"), F.lit(100)).alias("wide"))
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(common.bounded(side)) and "broadcast" not in plan(common.bounded(side, rows=99)) and "broadcast" not in plan(common.bounded(side, size=5000))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_binary_fuse(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = exact.BinaryFuse.build(np.concatenate([keys, keys[:1]]))
    assert f.may_contain(keys).all()
    assert f.may_contain(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 1e-3


def brute_fingerprint(text):
    w = WORDS.findall((text or "").translate(FOLD))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (id, fingerprint); the smallest id reachable."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(rows), 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_simhash(spark, name, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(rows, brute_components(rows), strict=True))
    assert sorted((str(a), b, str(c)) for a, b, c in simhash.classes(spark, docs).collect()) == want


@pytest.mark.parametrize("crowded", [10, 1 << 15])
def test_dense_bucket_and_long_chain(spark, monkeypatch, crowded):
    """A crowded ball of fingerprints, which goes by the finest blocks if buckets count as crowded early, and a chain whose ends are far apart."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63, dtype=np.uint64))
    prints = {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a, 40)}
    prints |= {((1 << (2 * i)) - 1) for i in range(32)} | {int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    rows = sorted(simhash._signed(f) for f in prints)
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    scratch = Scratch(spark, "test")
    edges = scratch.save(simhash.links(scratch.save(spark.createDataFrame([(f,) for f in rows], "fp long"), "prints"), scratch), "edges")
    roots = {r.node: r.root for r in simhash.components(edges, scratch).collect()}
    assert [roots.get(f, f) for f in rows] == brute_components([(f, f & (1 << 64) - 1) for f in rows])
    assert all((a ^ b).bit_count() <= 3 if (a < 0) == (b < 0) else ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges.collect())


def test_links_run_through_rows_without_an_id(spark, monkeypatch):
    """1 and 2 meet only through a row with a null id, 5 stands beside null ids, and one pair has no id at all."""
    prints = {"a": 0, "b": 0b111, "c": 0b111111, "d": 0b11111 << 40, "e": (0b11111 << 40) | (1 << 50), "f": 0xFF << 52, "g": 0x3F << 54}
    monkeypatch.setattr(simhash, "_fingerprints", lambda batches: (pa.record_batch([b.column(0), b.column(2), pa.array([simhash._signed(prints[t]) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "h", "fp"]) for b in batches))
    rows = [(1, "a"), (None, "b"), (2, "c"), (5, "d"), (None, "e"), (None, "f"), (None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.classes(spark, docs).collect())
    want = [(i, prints[t], c) for (i, t), c in zip(rows, (1, 1, 1, 5, 5, None, None), strict=True)]
    assert got == sorted((str(i), f"{p:016x}", c) for i, p, c in want)
    kept = sorted(str(r.doc_id) for r in simhash.keep_one(spark, docs).collect())
    assert kept == ["1", "5", "None"]


def test_masks_never_lose_a_pair():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**9, 10**11):
        choices = simhash.masks(n)
        for _ in range(200):
            flip = sum({1 << int(b) for b in rng.integers(0, 64, 3)})
            assert any(not flip & m for m in choices)


def test_near_copies_keep_one(spark, odd, empty):
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 10").count() == 0 and kept.where("doc_id is null").count() == 1
    assert simhash.classes(spark, empty).count() == 0
