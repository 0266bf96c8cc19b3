"""URL filter, language-model scores and toxicity against brute force, direct formulas or held-out accuracy."""

import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest

from lodestone.llm import lm, toxicity, urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host, path = m[1].translate(FOLD), m[2]
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls(spark):
    odd = [None, "", "x.org/en/", "http://org/", "http://A.ORG", "http://www.Example.org/es/1", "http://example.org/en/12?x=/es/", "http://example.org/en/2", "http://notexample.org/es/", "a://b://c.org/x", "http://x.com/de/#a", "http://x.com/fr", "://", "http://é.com/fr/日本", "https://u:p@h.com:80/de/", "http://x.net/" + "y" * 50_000, "http://x\n.com/de/a\nb"]
    rows = [(i, u, "h", None, "p") for i, u in enumerate(odd)] + [(None, "http://x.org/", None, "r", "p"), (3, "http://org/", None, "r", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, r string, p string")
    got = urls.judge(spark, pages).collect()
    want = Counter((r[0], *brute_url(r[1])[:3]) for r in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(odd):
        assert by_id[i].verdict == (brute_url(u)[3] or ("block" if by_id[i].block_score >= 0.5 else "allow"))
    assert urls.judge(spark, pages.limit(0)).count() == 0


def test_url_model(spark):
    pages = spark.createDataFrame([(0, "http://www.spam-farm.example.net/en/5"), (1, "https://blog.ththor.example.net/en/25"), (2, "https://poker-bets.example.com/en/680"), (3, "http://music-school.example.net/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(spark, pages).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "allow"}
    assert urls.fit(spark.createDataFrame([("http://a.b/", 1)], "url string, block int")) == ([0.0] * urls.DIM, -1.0)


def test_url_model_held_out(spark):
    """Five folds of the labelled table, judged by models that have not seen them; no labelled host is a page's."""
    rows = urls.labelled_urls()
    fold = [zlib.crc32(u.encode()) // 7 % 5 for u, _ in rows]
    right = 0
    for f in range(5):
        train = spark.createDataFrame([r for r, x in zip(rows, fold, strict=True) if x != f], "url string, block int")
        test = [r for r, x in zip(rows, fold, strict=True) if x == f]
        out = urls.judge(spark, spark.createDataFrame([(i, u) for i, (u, _) in enumerate(test)], "page_id long, url string"), train, rules=())
        right += sum((r.verdict == "block") == (test[r.page_id][1] == 1) for r in out.collect())
    assert right / len(rows) > 0.9
    hosts = {urlsplit(u).netloc for u, _ in rows}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(urls.host(urls.F.col("url")).alias("host")).distinct().collect()
    assert not hosts & {r.host for r in pages} and len(rows) < 200


def test_url_scores_equal_the_formula(spark):
    """The JVM expression against the weights by hand, with Spark's hash of each gram."""
    weights, intercept = urls.fit(spark.createDataFrame(urls.labelled_urls(), "url string, block int"))
    cases = ["http://free-bets.example.com/en/12", "http://a.b/", "nothing", None, "https://www.x.org"]
    out = {r.page_id: r.block_score for r in urls.judge(spark, spark.createDataFrame(list(enumerate(cases)), "page_id int, url string")).collect()}
    for i, u in enumerate(cases):
        host, path, *_ = brute_url(u)
        grams = [(m, f"{m}{s}$"[j : j + 3]) for m, s in (("^", host), ("/", path)) if s for j in range(len(s))]
        at = [r[0] for r in spark.createDataFrame(grams or [("", "")], "m string, g string").select(urls.F.pmod(urls.F.xxhash64("m", "g"), urls.F.lit(urls.DIM))).collect()][: len(grams)]
        z = sum(weights[x] for x in at) / max(1, len(at)) ** 0.5 + intercept
        assert out[i] == pytest.approx(1 / (1 + np.exp(-z)))


def ppm(counts, a, b, s):
    """The probability of s behind (a, b), straight from the definition."""
    contexts = [{x: n for (i, j, x), n in counts.items() if (i, j) == (a, b)}, Counter(), Counter()]
    for (_, j, x), n in counts.items():
        contexts[2][x] += n
        if j == b:
            contexts[1][x] += n
    p, out = 1.0, set()
    for c in contexts:
        left = {x: n for x, n in c.items() if x not in out}
        total, kinds = sum(left.values()), len(left)
        if s in left:
            return p * left[s] / (total + kinds)
        if kinds:
            p *= kinds / (total + kinds)
        out |= set(c)
    return p / (lm.SYMBOLS - len(out))


def test_ppm_table_and_scores():
    texts = [b"abracadabra", b"", b"banana band", "été".encode(), b"a"]
    counts = Counter()
    for t in texts:
        x = [lm.END, lm.END, *t, lm.END]
        counts.update(zip(x, x[1:], x[2:], strict=False))
    at = np.array([(a * lm.SYMBOLS + b) * lm.SYMBOLS + s for a, b, s in counts])
    trie = lm.Trie(at, np.array(list(counts.values())))
    for t in [*texts, b"zebra", b"ab\xff", b"nab"]:
        x = [lm.END, lm.END, *t, lm.END]
        want = sum(np.log10(ppm(counts, *c)) for c in zip(x, x[1:], x[2:], strict=False))
        assert trie.scores([t])[0] == pytest.approx(want, rel=1e-5)
    both = trie.scores([b"nab", b"", b"ABRA"])
    assert both.tolist() == pytest.approx([trie.scores([t])[0] for t in (b"nab", b"", b"abra")])
    probs = 10.0 ** trie.log10.reshape(lm.SYMBOLS, lm.SYMBOLS, lm.SYMBOLS)
    assert probs[ord("a"), ord("b")].sum() == pytest.approx(1, rel=1e-3) and probs[7, 9].sum() == pytest.approx(1, rel=1e-3)


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
def test_language_model(spark, name, request, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, WORDS.findall((r.text or "").translate(FOLD))) for r in docs.select("doc_id", "text").collect()]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, words in rows if not out(i) for w in [*words, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 6)) for i, w in rows)
    got = lm.score(spark, docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def long_ppm(texts, t):
    """log10 probability of t after training on texts, order by order, straight from the definition."""
    pad = [lm.END] * lm.ORDER
    seen = {}
    for x in texts:
        x = [*pad, *x, lm.END]
        for i in range(lm.ORDER, len(x)):
            for k in range(lm.ORDER + 1):
                seen.setdefault(tuple(x[i - k : i]), Counter())[x[i]] += 1
    x, total = [*pad, *t, lm.END], 0.0
    for i in range(lm.ORDER, len(x)):
        p, out = 1.0, set()
        for k in range(lm.ORDER, -1, -1):
            c = seen.get(tuple(x[i - k : i]), Counter())
            left = {s: n for s, n in c.items() if s not in out}
            if x[i] in left:
                p *= left[x[i]] / (sum(left.values()) + len(left))
                break
            if left:
                p *= len(left) / (sum(left.values()) + len(left))
            out |= set(c)
        else:
            p /= lm.SYMBOLS - len(out)
        total += np.log10(p)
    return total


def test_ppm_uses_long_contexts(spark):
    texts = ["abcdeX abcdfY abcdeX", "", None, "banana bandana", "été", "zbcdeZ zbcdfW zbcdeZ", "abcdeZ"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forms = [(t or "").translate(FOLD).encode() for t in texts]
    train = [t for i, t in enumerate(forms) if zlib.crc32(str(i).encode()) % 7 != 2]
    for r in lm.score(spark, docs).collect():
        assert r.score == pytest.approx(long_ppm(train, forms[r.doc_id]), rel=1e-5)


def test_network_gradients():
    """Backpropagation against finite differences."""
    net, rng = toxicity.Network(1), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors = rng.normal(size=(9, toxicity.WIDTH))
    docs, toxic = [rng.integers(0, 9, n) for n in (3, 30, 50)], np.array([True, False, True])
    g, d_vec, _ = toxicity._gradients(net, docs, toxic, vectors)
    loss = lambda: toxicity._gradients(net, docs, toxic, vectors)[2]
    for k, grad in [*g.items(), ("vectors", d_vec)]:
        x = vectors if k == "vectors" else net.p[k]
        for at in rng.integers(0, x.size, 3):
            was = x.flat[at]
            x.flat[at] = was + 1e-3
            up = loss()
            x.flat[at] = was - 1e-3
            down = loss()
            x.flat[at] = was
            assert np.asarray(grad).flat[at] == pytest.approx((up - down) / 2e-3, abs=3e-4)


def test_windows_cover_all_words():
    for n in range(1, 200):
        s = toxicity.windows(n)
        assert s[0] == 0 and s[-1] + toxicity.WINDOW >= n and (np.diff(s) == toxicity.STRIDE).all() and (len(s) == 1 or s[-1] < n)


def test_toxicity_held_out(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    net = toxicity.fit(spark, docs, labels)
    out = toxicity.judge(spark, docs, net).join(labels, "doc_id").where("held_out").toPandas()
    toxic = out.toxic == 1
    assert out.predicted[toxic].mean() > 0.8 and out.predicted[~toxic].mean() < 0.03
    assert (out.predicted == (out.score >= 0.3)).all() and out.score.between(0, 1).all()
    assert toxicity.judge(spark, empty, net).count() == 0 and toxicity.judge(spark, odd, net).count() == odd.count()
    assert toxicity.fit(spark, empty, labels).p["c"][0] == -3


def test_toxicity_sample_is_bounded_by_words(spark, monkeypatch):
    """Repeated ids and long texts: the bound is words, and it comes before the number of documents."""
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 5)
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 3)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts, toxic.tolist())))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:20]
    docs = spark.createDataFrame([(i, "w " * (50 if k % 2 else 3)) for k, i in enumerate(ids)] + [(ids[0], "a b")] * 5 + [(ids[2], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    toxicity.fit(spark, docs, labels)
    texts, toxic = seen[0]
    assert len(texts) == 3 and all(len(t.split()) <= 5 for t in texts) and len(toxic) == 3


def test_toxicity_batches_are_bounded():
    docs = [np.zeros(n, np.int64) for n in (1, 40_000, 2, 9000, 9000, *[5] * 200)]
    got = list(toxicity._batches(np.arange(len(docs)), docs))
    assert sorted(np.concatenate(got).tolist()) == list(range(len(docs)))
    assert all(len(b) == 1 or (len(b) <= toxicity.BATCH and sum(len(docs[i]) for i in b) <= toxicity.BATCH_WORDS) for b in got)


def test_scores_equal_a_plain_network():
    """The scorer's windows against one window at a time, gate by gate."""
    net = toxicity.Network(3)
    texts = ["one", "", "Du Idiot! " + "wort " * 70, " ".join(f"w{i}" for i in range(37))]
    got = toxicity.Scorer(net).scores([t.encode() for t in texts])
    sig = lambda x: 1 / (1 + np.exp(-x))
    for t, score in zip(texts, got, strict=True):
        words = t.encode().split() or [b""]
        vectors = net.vectors(*toxicity.features(words)).astype(float)
        best = 0.0
        for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if len(words) > toxicity.WINDOW else [0]:
            part = vectors[at : at + toxicity.WINDOW]
            states = []
            for d, order in (("0", range(len(part))), ("1", range(len(part) - 1, -1, -1))):
                h, out = np.zeros(toxicity.HIDDEN), {}
                for i in order:
                    g, q, n = part[i] @ net.p["W" + d] + net.p["b" + d], h @ net.p["U" + d], toxicity.HIDDEN
                    r, z = sig(g[:n] + q[:n]), sig(g[n : 2 * n] + q[n : 2 * n])
                    h = (1 - z) * np.tanh(g[2 * n :] + r * q[2 * n :]) + z * h
                    out[i] = h
                states.append([out[i] for i in range(len(part))])
            h = np.concatenate(states, axis=1)
            a = np.exp(h @ net.p["v"])
            best = max(best, sig((a / a.sum()) @ h @ net.p["o"] + net.p["c"][0]))
        assert score == pytest.approx(best, abs=1e-6)
