"""Quality rules and personal data against brute force."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
import regex

from lodestone.llm import pii, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_base_counts(spark, name, request):
    docs = request.getfixturevalue(name)
    out = quality.judge(spark, docs, np.zeros(quality.BUCKETS)).collect()
    want = sorted((str(r.doc_id), *brute_counts(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), *(r[x] for x in quality.BASE)) for r in out) == want


def test_ratio_separates_labelled_documents(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.judge(spark, docs, quality.fit(spark, docs, labels)).join(labels, "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert (good.score >= quality.THRESHOLD).mean() == 1
    assert good[~good.base_failed].kept.all() and bad.kept.mean() < 0.1
    assert len(quality.keep_good(spark, docs, quality.fit(spark, docs, labels)).columns) == len(docs.columns)


def test_large_vocabulary_windows():
    words = [str(i).encode() for i in range(5000)] + [b"a", b"b", b"c", b"d", b"e"] * 2
    assert quality._repeat_words(words) == brute_counts(b" ".join(words).decode())[4]


def test_quality_without_labels(spark, odd, empty):
    ratios = quality.fit(spark, odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert not ratios.any()
    assert quality.judge(spark, empty, ratios).count() == 0
    assert quality.keep_good(spark, odd, ratios).columns == odd.columns


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            if kind == "card":
                luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d))))
                if not 14 <= len(d) <= 19 or luhn % 10:
                    continue
            out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


@pytest.mark.parametrize("name", ["odd", "documents", "tricky"])
def test_base_spans(spark, name, request):
    if name == "tricky":
        texts = ["a@b.co@d.ef a@b..c -@-.- é@x.y x@é.y 1.2.3.4.5.6.7.8.9 00001.2.3.4 999999999999999999999.1.1.1", "4111111111111111 4111-1111 1111-1111 5 - 5 41111111111111111111", "+1 2 +49 (30) 1234-5678. +0.0.0.0.0.0.0.0.0.0.0.0", "日本 a@b.cc 😀 +1 (017) 555-7713 😀 152.143.123.131", "%%%@a.b 12 34-56 78 90-12 34 56 78", "1" * 3000, "a" * 3000 + "@" + "b.c" * 3000]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        docs = request.getfixturevalue(name)
    out = pii.find(spark, docs).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(",".join(brute_spans(r.text)).encode()).hexdigest(), len(brute_spans(r.text))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in out) == want


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"Dial hotline +1 212 555 {1000 + i} today. Server address 10.0.{i}.7 is up. Value {i * 7919 + 1000} seen.") for i in range(20)]
    rows += [(100, "Server address fe80:1::9 is up."), (101, "Value 55555 seen."), (102, None)]
    out = {r.doc_id: r for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].spans == "ip:15:24" and out[100].n_ip == 0 and out[100].n_added == 1
    assert out[101].spans == "" and out[102].spans == ""
    assert out[3].n_added == 0


def test_context_finds_identifiers_with_blanks(spark):
    rows = [(i, f"Dial hotline +1 (212) 555-{1000 + i} today.") for i in range(20)] + [(100, "Dial hotline 212 555 9999 today."), (101, "Of 212 555 9999 none.")]
    out = {r.doc_id: r for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].spans == "phone:13:25" and out[100].n_phone == 0 and out[100].n_added == 1
    assert out[3].n_added == 0


def test_context_learns_from_what_it_found(spark):
    rows = [(i, f"Server address 10.0.{i}.7 is up.") for i in range(20)]
    rows += [(100 + i, f"Server address fe80:{i}::9 is up.") for i in range(12)] + [(200 + i, f"Behind gateway fe80:{i}::9 sits.") for i in range(12)]
    rows += [(300, "Behind gateway fe80:77::9 sits.")]
    out = {r.doc_id: r for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[300].spans == "ip:15:25"


def test_few_seeds_are_enough(spark):
    rows = [(i, f"Server address 10.0.{i}.7 is up.") for i in range(5)] + [(100, "Server address fe80:1::9 is up.")]
    out = {r.doc_id: r for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].spans == "ip:15:24"


def test_secrets_are_added(spark):
    """Seeds of the added kind: behind a key word, and wherever the same value stands; then whatever stands in such a context."""
    rows = [(i, f'the token = "{hashlib.sha1(str(i).encode()).hexdigest()}" of') for i in range(20)]
    rows += [(100, f"lone {hashlib.sha1(b'3').hexdigest()} here"), (101, 'the token = "ab-12.x" of'), (102, "version 2024.17 now"), (103, "API_KEY: AbCdEf0123456789"), (104, "token = abcdefghijklmnopqrst")]
    out = {r.doc_id: r for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].spans == "secret:13:53" and out[i].n_spans == out[i].n_added == 1 for i in range(20))
    assert out[100].spans == "secret:5:45" and out[101].spans == "secret:13:20" and out[103].spans == "secret:9:25"
    assert out[102].spans == out[104].spans == ""


def test_failed_checks_are_never_found(spark):
    """Numbers that look like cards and fail the check, in the context of cards."""
    rows = [(i, f"Charge card {n} now") for i, n in enumerate(("4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011000990139424", "30569309025904", "4222222222222220", "5105105105105100"))]
    rows += [(50, "Charge card 4111111111111112 now"), (51, "Charge card 999.1.2.3 now"), (52, "Charge card no-77-x now")]
    out = {r.doc_id: r.spans for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50] == out[51] == "" and out[0] == "card:12:28"


def brute_find(rows):
    """(base, added) spans of each text, from the definition: plain expressions, slices and dictionaries."""
    word, mark = r"[^\W]", r"[\W]"
    met = []
    for n, (_, t) in enumerate(rows):
        t = t or ""
        found = []  # start, end, kind (-1: near miss), piece before, piece behind
        for k, (kind, pattern) in enumerate(PLAIN.items()):
            hits = list(re.finditer(pattern, t))
            for i, m in enumerate(hits):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(x if j % 2 == 0 else 2 * x - 9 * (2 * x > 9) for j, x in enumerate(map(int, reversed(d)))) % 10 == 0
                if kind == "email":
                    as_ = k
                elif kind == "ip":
                    as_ = k if all(int(x) <= 255 for x in m[0].split(".")) else -1
                elif kind == "card":
                    as_ = None if not 14 <= len(d) <= 19 else k if luhn else -1
                else:
                    as_ = k if 10 <= len(d) <= 15 else None
                if as_ is not None:
                    found.append((m.start(), m.end(), as_, t[hits[i - 1].end() if i else 0 : m.start()], t[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(t)]))
        hits = list(regex.finditer(pii.SECRET_SEED, t))
        for i, m in enumerate(hits):
            value = regex.search(pii.SECRET_VALUE + "$", m[0])[0]
            at = m.end() - len(value)
            found.append((at, m.end(), pii.SECRET, t[hits[i - 1].end() if i else 0 : at], t[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(t)]))
        ids = []
        for pattern in (pii.IDENTIFIER, pii.RUN):
            hits = list(regex.finditer(pattern, t))
            for i, m in enumerate(hits):
                a, b = m.start(), m.end()
                while a < b and not re.match("[A-Za-z0-9+]", t[a]):
                    a += 1
                while b > a and not re.match("[A-Za-z0-9]", t[b - 1]):
                    b -= 1
                if b - a >= 4:
                    ids.append((a, b, None, t[hits[i - 1].end() if i else 0 : a], t[b : hits[i + 1].start() if i + 1 < len(hits) else len(t)]))
        touch = lambda x, y: x[0] < y[1] and y[0] < x[1]
        base = [f for f in found if 0 <= f[2] < pii.SECRET]
        others = [f for f in found if f not in base and not any(touch(f, b) for b in base)]
        for f in [*base, *others, *(x for x in ids if not any(touch(x, f) for f in found))]:
            before, last = re.findall(word + "+", f[3])[-2:-1], re.findall(word + "+", f[3])[-1:]
            next_ = re.findall(word + "+", f[4])[:1]
            marks = re.sub(r"\s", "", re.search(mark + "*$", f[3])[0]) if last else ""
            value = t[f[0] : f[1]]
            form = re.sub("(?:9a|a9)[9a]*", "x", regex.sub(r"\p{N}+", "9", regex.sub(r"\p{L}+", "a", value))) + "|" + str(len(value).bit_length() - 1)
            low = lambda xs: [x.lower() for x in xs]
            parts = [("L", last), ("LL", before + last if before and last else []), ("R", next_), ("LR", last + next_ if last and next_ else []), ("LM", last + [marks] if last and marks else []), ("LS", last + [form] if last else []), ("MS", [marks, form] if marks else [])]
            ps = {" ".join([m, *(low(x[:-1]) + [x[-1].lower() if m in ("L", "LL", "R", "LR") else x[-1]])]) for m, x in parts if x}
            met.append((n, f[0], f[1], f[2], value, ps))
    seed, miss = {}, {x[4] for x in met if x[3] == -1}
    for x in met:
        if x[3] is not None and x[3] >= 0:
            seed[x[4]] = min(seed.get(x[4], 9), x[3])
    instances = {}
    for *_, value, ps in met:
        for p in ps:
            instances.setdefault(p, set()).add(value)
    found = {}
    for _ in range(pii.ROUNDS):
        sure = {}
        for p, vs in instances.items():
            for k in range(len(pii.NAMES)):
                own = sum(seed.get(v) == k for v in vs)
                gained = [found[v, k] for v in vs if (v, k) in found]
                seeds, misses = sum(v in seed for v in vs), sum(v in miss for v in vs)
                s = own + sum(gained)
                if s >= pii.MIN_SUPPORT and (c := s / (s + seeds - own + misses + pii.UNKNOWN * (len(vs) - seeds - misses - len(gained)) + pii.SMOOTHING)) >= pii.MIN_CONFIDENCE:
                    sure[p, k] = c
        found = {}
        for (p, k), c in sure.items():
            for v in instances[p]:
                if v not in seed and v not in miss:
                    found[v, k] = 1 - (1 - found.get((v, k), 0)) * (1 - min(c, 0.999999))
    out = [(set(), set()) for _ in rows]
    marks_ = {}
    for n, a, b, kind, value, ps in met:
        if kind is None:
            told = [(-c, k) for (p, k), c in sure.items() if p in ps] + ([(-1.0, seed[value])] if value in seed else [])
        else:
            told = [(-1.0, kind)] if kind >= pii.SECRET else []
            if 0 <= kind < pii.SECRET:
                out[n][0].add((a, kind, b))
        for x in told:
            marks_[n, a, b] = min(marks_.get((n, a, b), x), x)
    for n, a, b in sorted(marks_, key=lambda x: (x[0], x[1], -x[2])):
        if not any(m == n and (c, -d) < (a, -b) and d >= b for m, c, d in marks_):
            out[n][1].add((a, marks_[n, a, b][1], b))
    return out


@pytest.mark.parametrize("name", ["odd", "documents", "made"])
def test_added_spans_equal_brute_force(spark, name, request):
    if name == "made":
        rng = np.random.default_rng(2)
        values = lambda i: [f"a{i}@b.co", f"10.1.{i % 256}.9", "4111111111111111", f"+1 (212) 555-{1000 + i}", f"x-{i}-77", f"token = {hashlib.md5(str(i).encode()).hexdigest()}", f"{i} {i + 5}", "4111111111111112", "999.1.1.1"]
        heads = ["mail", "host", "card", "phone no", "ref:", "at (", "key ="]
        rows = [(i, " ".join(f"{heads[h]} {values(i % 90)[h if rng.random() < 0.7 else int(rng.integers(9))]} end{int(rng.integers(3))}." for h in rng.integers(0, 7, 3))) for i in range(150)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for (i, _), (base, added) in zip(rows, brute_find(rows), strict=True):
        want.append((str(i), ",".join(f"{pii.NAMES[k]}:{a}:{b}" for a, k, b in sorted(base | added)), len(added)))
    got = pii.find(spark, docs).collect()
    assert sorted((str(r.doc_id), r.spans, r.n_added) for r in got) == sorted(want)
    assert name != "made" or sum(x[2] for x in want) > 10


def test_long_runs_take_linear_time(spark):
    n = 40_000
    texts = ["a" * n, "1" * n, "9" + "!" * n + "b", "1." * n, "+" * n, "1-" * n, "a@" * n, "@" + "a." * n, " " * n + "7", "1.2.3.4 " * n, "token=" * n + "1", ("x" * 50 + " ") * n + "9abc"]
    began = time.time()
    assert pii.find(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)
    assert time.time() - began < 120


def test_redaction(spark, odd):
    out = {r.doc_id: r.text for r in pii.redact(spark, odd).collect()}
    assert out[15] == "mail [EMAIL], [PHONE] now"
    assert out[0] is None and out[1] == "" and pii.redact(spark, odd).columns == odd.columns
    other = lambda df: sorted(map(str, df.drop("text").collect()))
    assert other(pii.redact(spark, odd)) == other(odd)


def test_quality_held_out(spark):
    """Fitted on half of the labels, judged on the other half, by language."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars < 20000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = quality.F.pmod(quality.F.xxhash64("doc_id"), quality.F.lit(2))
    out = quality.judge(spark, docs, quality.fit(spark, docs, labels.where(half == 0))).join(labels.where(half == 1), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    passing = out[~out.base_failed]
    for _, part in passing[passing.quality == 1].groupby("lang"):
        assert part.kept.mean() > 0.97
    assert out[out.quality == 0].kept.mean() < 0.15
