"""The pipeline against a brute-force version of its stages, and its contract."""

import math
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from lodestone.llm import packing, quality

from .test_dedup import FOLD, WORDS, brute_components, brute_fingerprint
from .test_filters import brute_counts, brute_spans

SF = "/root/testdata/sf0.001"


def brute_grams(text):
    out, b = [], (text or "").encode()
    for i in range(len(b) - quality.GRAM + 1):
        h = int.from_bytes(b[i : i + quality.GRAM], "big")
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        h ^= h >> 12
        h = h * 0x297A2D39 & 0xFFFFFFFF
        out.append(h >> (32 - quality.BUCKET_BITS))
    return out


def brute_quality(rows, good):
    raw, target = defaultdict(int), defaultdict(int)
    grams = [brute_grams(t) for _, t in rows]
    for (i, _), g in zip(rows, grams, strict=True):
        for x in g:
            raw[x] += 1
            target[x] += i in good
    n_raw, n_target, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    kept = []
    for (i, t), g in zip(rows, grams, strict=True):
        n, _, _, _, repeated = brute_counts(t)
        score = sum(math.log((target[x] + 1) / (n_target + b)) - math.log((raw[x] + 1) / (n_raw + b)) for x in g) / max(1, len(g)) if n_target else 0
        if n >= 10 and 100 * repeated <= 20 * n and score >= quality.THRESHOLD:
            kept.append((i, t))
    return kept


def brute_exact(rows):
    best = {}
    for i, t in rows:
        form = (t or "").translate(FOLD)
        best[form] = max(best.get(form, -1), i)
    return [(i, t) for i, t in rows if best[(t or "").translate(FOLD)] == i]


def brute_near(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    return [r for r, c in zip(rows, brute_components(prints), strict=True) if r[0] == c]


def brute_redact(rows):
    out = []
    for i, t in rows:
        done, parts = 0, []
        for s in brute_spans(t):
            kind, a, b = s.split(":")
            if int(a) >= done:
                parts += [t[done : int(a)], f"[{kind.upper()}]"]
            done = max(done, int(b))
        out.append((i, "".join([*parts, (t or "")[done:]]) if parts else t))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage leaves, written and read again between them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark, stages):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    for brute, got in zip((lambda x: brute_quality(x, good), brute_exact, brute_near, brute_redact), stages, strict=False):
        rows = brute(rows)
        assert sorted((r.doc_id, r.text) for r in got.collect()) == rows
    assert sorted((r.doc_id, r.n_tokens) for r in stages[-1].collect()) == [(i, len(WORDS.findall(t or "")) + 1) for i, t in rows]


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1]) and len(corpus_pipeline.STAGES) == 5


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_no_personal_data_is_left(stages):
    left = [s for r in stages[3].collect() for s in brute_spans(r.text)]
    assert not left and any(re.search(r"\[EMAIL\]", r.text or "") for r in stages[3].collect())


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_awkward_documents(spark, name, request):
    docs = request.getfixturevalue(name)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        docs = out
    assert docs.count() <= 60 and packing.BUDGET > 0
