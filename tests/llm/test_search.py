"""Ranked search, token alignment and embedding near-duplicates against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers

from lodestone.llm import align, embeddings, ranked
from lodestone.llm.common import Scratch
from tests.llm.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(plain_terms(text)).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=20):
    return sorted(map(tuple, ranked.search(spark, ranked.build(spark, docs, Scratch(spark, "test").root), items, k).collect()), key=str)


def test_search_equals_brute_force_on_awkward_rows(spark, odd, monkeypatch):
    items = [(0, "quick brown FÔX quick"), (1, None), (1, "..."), (2, "lazy dogs été über 日本語 x@y"), (None, "one two three"), (2, "unheardof word"), (3, "quick " * 50 + "a.b 42")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as number", "'x' as term", "2L as score", "3 as doc_id")
    want = plain_search([(r.doc_id, r.text) for r in odd.collect()], items, 7)
    assert want and searched(spark, odd, asked, 7) == want
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 3)
    monkeypatch.setattr(ranked, "SLICE", 2)
    assert searched(spark, odd, asked, 7) == want


def test_search_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "quick")], "item_id long, text string")
    assert searched(spark, empty, items) == [] and searched(spark, odd, items.limit(0)) == []


def test_bytes_bound_every_impact():
    rng = np.random.default_rng(3)
    tf, m = rng.integers(1, 5000, 20_000), rng.integers(75, 100_000, 20_000)
    q = ranked.impact(tf, m)
    level = (q * 255 + ranked.TOP - 1) // ranked.TOP
    assert level.max() <= 255 and (ranked.LOWER[level] <= q).all() and (q <= ranked.UPPER[level]).all()


def test_search_keeps_ties_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(100, 0, -1)], "doc_id long, text string").repartition(5)
    assert [r.doc_id for r in ranked.search(spark, ranked.build(spark, docs, Scratch(spark, "test").root), docs.where("doc_id = 7").selectExpr("doc_id as item_id", "text"), 20).orderBy("rank").collect()] == list(range(1, 21))


def plain_alignment(rows):
    """By whole texts and by offsets."""
    p, out, held = align.Pair(A, B), [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        sides = [p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text)] if text else [[], []]
        if not text or any(b"".join(tokens[t] for t in ids) != whole for ids, tokens in zip(sides, p.transducer.bytes, strict=True)):
            out.append((i, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(tokens[t]) for t in ids]) for ids, tokens in zip(sides, p.transducer.bytes, strict=True)]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        links = []
        for x, (s, e) in enumerate(zip(starts[0], ends[0], strict=True)):
            links += [(sides[0][x], sides[1][y]) for y in np.flatnonzero((starts[1] < e) & (ends[1] > s))]
        groups, at = [], [0, 0]
        for e in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
            to = [int(np.searchsorted(x, e)) + 1 for x in ends]
            groups.append("|".join(",".join(map(str, ids[f:t])) for ids, f, t in zip(sides, at, to, strict=True)))
            at = to
        held.update(set(links))
        out.append((i, len(sides[0]), len(sides[1]), links, ";".join(groups)))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return sorted(((i, n, m, g.count("|"), len(x), sum(held[y] == most[y[0]] for y in x), sum(held[y] for y in x), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, n, m, x, g in out), key=str)


def aligned(spark, docs):
    return sorted(map(tuple, align.digests(spark, docs, A, B).collect()), key=str)


def test_alignment_equals_whole_texts_on_awkward_rows(spark, odd, monkeypatch):
    rng = random.Random(4)
    alphabet = ["a", "Z", "é", " ", "  ", "\n", "\t", " ", " ", "​", "▁", "ﬁ", "日", "🙂", "é", "'s", "123", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "\x1c", "\x85", ".", "--", "word", "Haus"]
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts = more + [x.replace("▁", "").replace("\x00", "") for x in more] + ["blank ▁ sign", "x" * 3000]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(1000 + i, t) for i, t in enumerate(texts)]
    docs = odd.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    want = plain_alignment(rows)
    assert sum(r[1] > 0 for r in want) > 400
    assert aligned(spark, docs) == want
    monkeypatch.setattr(align, "bounded", lambda side, *_: side)  # the table of pairs is shuffled
    assert aligned(spark, docs) == want


def test_alignment_of_documents_and_of_no_rows(spark, documents, empty):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert aligned(spark, documents) == plain_alignment(rows)
    assert aligned(spark, empty) == []


def test_transducer_refuses_other_bytes_and_forgets():
    t = align.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"x"])
    flat = lambda *x: np.array(x, np.int64)
    good, unit, i, j, closes = t.align((flat(0, 1, 2, 0), flat(0, 1, 2, 0)), (flat(2, 1, 1), flat(2, 1, 1)))
    assert good.tolist() == [True, False, False]
    assert list(zip(unit, i, j, closes, strict=True)) == [(0, 0, 0, False), (0, 0, 1, False), (0, 1, 1, True)]


def near(rng, x, cosine):
    y = rng.standard_normal(len(x))
    y -= (y @ x) * x
    return cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def vectors():
    rng, rows = np.random.default_rng(8), []
    for label in (1, 2, None):
        for c in range(12):
            x = rng.standard_normal(48)
            x /= np.linalg.norm(x)
            rows += [(label, x * 3), (label, x * 3)]
            rows += [(label, near(rng, x, cosine)) for cosine in (0.999, 0.99, 0.985, 0.981, 0.979, 0.9)]
            if c < 2:
                rows += [(label, near(rng, x, 0.995)) for _ in range(60)]
        rows += [(label, rng.standard_normal(48)) for _ in range(40)] + [(label, rng.standard_normal(5))] * 3
    rows = [(i, [float(v) for v in x], label) for i, (label, x) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 48, 1), (n + 3, [None] + [1.0] * 47, 1), (n + 4, [float("nan")] * 48, 1), (n + 5, [float("inf")] + [1.0] * 47, 1)]
    rows += [(None, rows[0][1], 1), (None, [7.0] * 6, 2), (3, rows[3][1], 1), (n + 6, [1e300] * 6, 2), (n + 7, [1e-300] * 6, 2), (n + 8, [-0.0] * 5 + [1.0], 1), (n + 9, [0.0] * 5 + [1.0], 1)]
    return rows


def plain_links(rows):
    ok = [bool(v) and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [embeddings.unit(np.array([v]))[0] if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        stack, members = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in members:
                    members.add(j)
                    stack.append(j)
        seen |= members
        head = min((rows[j][0] for j in members if rows[j][0] is not None), default=None)
        for j in members:
            out[j] = (rows[j][0], len(links[j]), head, rows[j][0] is not None and rows[j][0] == head)
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1024, 16])
def test_embedding_links_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(embeddings, "BLOCK", size)  # small parts: buckets are dealt to tasks by pairs of parts
    rows = vectors()
    source = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as digest", "1 as node", "2 as n", "3 as key", "4 as part", "5 as best", "6 as links")
    got = sorted(map(tuple, embeddings.classes(spark, source).collect()), key=str)
    want = plain_links(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert got == want


def test_embeddings_of_the_table_and_of_no_rows(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted(map(tuple, embeddings.classes(spark, table).collect()), key=str) == plain_links(rows)
    assert embeddings.classes(spark, table.limit(0)).collect() == []


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold share a table nearly always, for rotations fitted on unlike data too."""
    rng = np.random.default_rng(1)
    for nodes in (500, 1 << 20):
        bits, count = embeddings.tables(nodes)
        mean, turn = embeddings.rotations(embeddings.unit(rng.standard_normal((2000, 64))), 64, bits * count)
        x = embeddings.unit(rng.standard_normal((2000, 64)))
        y = np.stack([near(rng, v, embeddings.COSINE) for v in x])
        same = (((x - mean) @ turn > 0) == ((y - mean) @ turn > 0)).reshape(2000, count, bits).all(axis=2).any(axis=1)
        assert same.mean() >= 0.99
