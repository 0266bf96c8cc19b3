"""Stems, cover density, the stored index and symbol ranks against plain versions."""

import random
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import stemming
from lodestone.functions.text import FILLERS, py_split_camel
from lodestone.operators import lexical, ranking

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
#: Words of the algorithm's published sample with their stems.
SAMPLE = (
    "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consistency:consist consistently:consist consolation:consol consolatory:consolatori "
    "consolidate:consolid console:consol consolingly:consol consonant:conson conspicuously:conspicu conspiracy:conspiraci conspirators:conspir conspire:conspir constable:constabl "
    "constance:constanc constancy:constanc constant:constant knackeries:knackeri knave:knave knavish:knavish kneaded:knead knee:knee knees:knee kneeling:kneel knelt:knelt knightly:knight "
    "knives:knive knitting:knit knotted:knot generate:generat generously:generous general:general communism:communism community:communiti arsenal:arsenal skies:sky dying:die news:news "
    "inning:inning cries:cri ties:tie gas:gas gaps:gap kiwis:kiwi hopping:hop hoping:hope hoped:hope falling:fall bed:bed shred:shred by:by say:say enjoy:enjoy youth:youth yes:yes "
    "relational:relat rational:ration sensibility:sensibl possibly:possibl vietnamization:vietnam activate:activ formality:formal hopefulness:hope analogously:analog replacement:replac "
    "adoption:adopt rate:rate controll:control roll:roll agreed:agre feed:feed luxuriated:luxuri disabled:disabl size:size sizing:size running:run run:run a1:a1 running2:running2"
).split()


def test_stems_of_the_published_sample():
    assert {w: stemming.stem(w) for w, _ in (x.split(":") for x in SAMPLE)} == dict(x.split(":") for x in SAMPLE)
    assert stemming.lexeme("the") is None and len(stemming.STOP_WORDS) == 127


def plain_stem(word):
    """The same by regular expressions over marked regions."""
    fixed = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    if word in fixed or len(word) <= 2 or not re.fullmatch("[a-z]+", word) or word in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"):
        return fixed.get(word, word)
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    m = re.match("(gener|commun|arsen)|.*?[aeiouy][^aeiouy]", w)
    r1 = m.end() if m else len(w)
    m = re.match(".*?[aeiouy][^aeiouy]", w[r1:])
    r2 = r1 + (m.end() if m else len(w) - r1)
    short = lambda x: bool(re.search("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", x))
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("ie[ds]$", w):
        w = re.sub("ie[ds]$", "i" if len(w) > 4 else "ie", w)
    elif re.search("[^us]s$", w) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if re.fullmatch("(inn|out|cann|herr|earr)ing|(pro|ex|suc)ceed", w):
        return w
    if m := re.search("eed(ly)?$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ed|ing)(ly)?$", w)) and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if re.search("(at|bl|iz)$", w):
            w += "e"
        elif re.search(r"([bdfgmnprt])\1$", w):
            w = w[:-1]
        elif short(w) and len(w) <= r1:
            w += "e"
    w = re.sub("(?<=.[^aeiouy])[yY]$", "i", w)
    rules = [
        (r1, "ational ate,tional tion,ization ize,fulness ful,ousness ous,iveness ive,biliti ble,lessli less,entli ent,ation ate,alism al,aliti al,ousli ous,iviti ive,fulli ful,enci ence,anci ance,abli able,izer ize,ator ate,alli al,bli ble,(?<=l)ogi og,ogi ogi,(?<=[cdeghkmnrt])li ,li li"),
        (r1, "ational ate,tional tion,alize al,icate ic,iciti ic,ical ic,ness ,ative *,ful "),
        (r2, "ement ,ance ,ence ,able ,ible ,ment ,ant ,ent ,ism ,ate ,iti ,ous ,ive ,ize ,(?<=[st])ion ,ion ion,al ,er ,ic "),
    ]
    for region, listed in rules:
        for rule in listed.split(","):
            ending, new = rule.split(" ")
            if m := re.search(ending + "$", w):
                if m.start() >= (r2 if new == "*" else region):
                    w = w[: m.start()] + new.strip("*")
                break
    if (w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not short(w[:-1])))) or (w.endswith("ll") and len(w) > r2):
        w = w[:-1]
    return w.lower()


def test_stems_of_arrays_keep_nulls_and_make_each_distinct_word_once(spark, monkeypatch):
    rows = [["idiots", "the", "clowns"], None, [], ["d12", "idiots", None, "été"], ["clowns"]] * 40
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, ws array<string>").coalesce(1)
    got = [r.s for r in table.orderBy("id").select(stemming.lexemes(F.col("ws")).alias("s")).collect()]
    assert got == [None if r is None else [None if w is None else stemming.lexeme(w) for w in r] for r in rows]
    asked = []
    monkeypatch.setattr(stemming, "lexeme", lambda w: asked.append(w) or w)
    words = pa.array(rows, pa.list_(pa.string()))
    assert stemming.stems_of(words.slice(1, 150)).to_pylist() == rows[1:151]
    assert len(asked) == 5 and stemming._stem.cache_info().maxsize <= 1 << 16


def test_memory_of_stems_does_not_grow_with_the_distinct_words():
    """In a process of its own, as a worker is: what Python's objects take at most, for few and for many distinct words, and no pandas."""
    code = """
import itertools, sys, tracemalloc
import pyarrow as pa, pyarrow.compute as pc
from lodestone.functions import stemming
texts = ["the", "idiots"] + ["".join(x) for x in itertools.product("bdgknrst", "aeiou", "bdgknrst", "aeiou", ["ning", "tions", "ed", "s", "12"], "xyz")]
peaks = []
for n in (2, 6000, len(texts)):
    told = pa.lib.StringBuilder()
    told.append(" ".join(texts[:n]))
    rows = pc.split_pattern(told.finish(), " ")
    tracemalloc.start()
    out = stemming.stems_of(rows)
    peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert out.to_pylist() == [[stemming.lexeme(w) for w in texts[:n]]]
print(*peaks[1:], "pandas" in sys.modules)
"""
    few, many, pandas = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(many) < 1.5 * int(few) and pandas == "False"


def test_stems_of_all_words_equal_the_plain_version(spark):
    found = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        found |= set(re.findall("[a-z]+", (r.text or "").lower()))
    rng = random.Random(2)
    parts = "gener commun arsen con sta bl at iz ing ed ly li eed s ies ous ful ness ational ization iviti biliti ogi y Y e ll tt er able ment ion sion tion al a o u th sky ".split()
    found |= {"".join(rng.choice(parts).lower() for _ in range(rng.randint(1, 5))) for _ in range(20_000)}
    wrong = [(w, stemming.stem(w), plain_stem(w)) for w in sorted(found) if stemming.stem(w) != plain_stem(w)]
    assert len(found) > 30_000 and wrong == []


def plain_rows(name, path, spine, summary):
    """(place, word, weight) of a file's index."""
    cut = lambda t: re.findall("[a-z0-9]+", t.lower())
    names, spine, summary = f"{name or ''} {path or ''}", spine or "", summary or ""
    apart = re.sub(r"[_/.\-]", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", f"{names} {spine}"))
    rows, at = [], 0
    for found, weight in ((cut(names), 1.0), ([stemming.lexeme(w) for w in cut(apart)], 1.0), (cut(spine), 0.4), ([stemming.lexeme(w) for w in cut(summary)], 0.2)):
        rows += [(at + i, w, weight) for i, w in enumerate(found, 1) if w is not None]
        at += len(found)
    return rows


def plain_density(rows, words):
    """All shortest runs that hold all words, found by trying every begin and end."""
    hits = [(p, w, x) for p, w, x in rows if w in words]
    runs = [(i, j) for i in range(len(hits)) for j in range(i, len(hits)) if {w for _, w, _ in hits[i : j + 1]} == set(words)]
    runs = [(i, j) for i, j in runs if not any((a, b) != (i, j) and i <= a and b <= j for a, b in runs)]
    return sum((j - i + 1) / sum(1 / x for _, _, x in hits[i : j + 1]) / (1 + hits[j][0] - hits[i][0] - (j - i)) for i, j in runs)


def plain_score(rows, query):
    plain = set(re.findall("[a-z0-9]+", query.lower()))
    stems = {stemming.lexeme(w) for w in plain} - {None}
    loose = {stemming.lexeme(w) for w in lexical.any_terms(query)} - {None}
    return (1.5 * plain_density(rows, plain) if plain else 0) + (1.25 * plain_density(rows, stems) if stems else 0) + sum(x for _, w, x in rows if w in loose)


@pytest.fixture
def quick(spark):
    """Many small plans: compiling each would take longer than running it."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, x in zip(kept, ("false", "1", "false"), strict=True):
        spark.conf.set(k, x)
    yield
    for k, x in kept.items():
        spark.conf.set(k, x)


def files(spark):
    rng = random.Random(9)
    pool = "run running runs rollUp episode episodes the of licence LICENSED auth.js src/auth token_refresh x1 y ability able".split()
    text = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    rows = [(i, f"f{i % 7}.js", f"src/{rng.choice(pool)}/f{i % 7}.js" if i % 5 else None, text(12) if i % 3 else None, text(40) if i % 4 else None) for i in range(150)]
    return rows, spark.createDataFrame(rows, "id long, file_name string, file_path string, symbol_spine string, summary string")


QUERIES = ["running episodes", "the of", "rollUp licensed the run", "zzz !!", "", "episode rollUp auth js src f1", "who is the of run ability"]


def test_scores_equal_the_plain_version_with_and_without_an_index(spark, quick, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 10)
    rows, table = files(spark)
    index = lexical.build(spark, lexical.places(table), f"{tmp_path}/index", len(rows))
    for q in QUERIES:
        want = {r[0]: s for r in rows if (s := plain_score(plain_rows(*r[1:]), q)) > 0}
        for found in (lexical.scores(table, q), index.scores(q)):
            got = {r.id: r.score for r in found.collect()}
            assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
        top = [(r.id, round(r.score, 9)) for r in index.top(q, 5).collect()]
        assert top == [(i, pytest.approx(s)) for s, i in sorted((-round(want[i], 9), i) for i in want)[:5] for s in [-s]]


def test_index_of_documents_skips_segments_and_equals_the_scan(spark, quick, tmp_path, monkeypatch):
    """Fifty queries of one to six words over all documents."""
    monkeypatch.setattr(lexical, "SEGMENT", 8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as id", "concat('d', doc_id) as file_name", "source as file_path", "lang as symbol_spine", "text as summary")
    index = lexical.build(spark, lexical.places(docs), f"{tmp_path}/index", 200)
    rows = {r.id: plain_rows(*r[1:]) for r in docs.collect()}
    held = defaultdict(int)
    for found in rows.values():
        for w in {w for _, w, _ in found}:
            held[w] += 1
    rng, skipped = random.Random(6), 0
    pool = sorted(w for w, n in held.items() if n < 60 and len(w) > 2)
    for n in range(50):
        q = " ".join(rng.sample(pool, 1 + n % 6))
        want = sorted(((-round(s, 8), i) for i, found in rows.items() if (s := plain_score(found, q)) > 0))[:5]
        assert [(-round(r.score, 8), r.id) for r in index.top(q, 5).collect()] == want
        skipped += index.seen[0] - index.seen[1]
    assert skipped > 0
    assert lexical.build(spark, lexical.places(docs.limit(0)), f"{tmp_path}/none", 0).top("run", 5).collect() == []


def test_keyword_and_hybrid_search_read_the_stored_index(spark, tmp_path):
    from tests.test_operators import AS_OF, blobs

    table = blobs(spark)
    index = lexical.build(spark, lexical.places(table), f"{tmp_path}/index", 5)
    for q in ("episodes rollups", "loose.js"):
        assert ranking.keyword_search(table, q, AS_OF, index=index).collect() == ranking.keyword_search(table, q, AS_OF).collect()
        a, b = (ranking.hybrid_search(table, q, [1.0, 0.0], AS_OF, index=x).select("id", "similarity", "lexical_score").collect() for x in (index, None))
        assert a == b
    some = table.where("id <> 2")
    assert ranking.hybrid_search(some, "episode rollups", [1.0, 0.0], AS_OF, index=index, scoped=True).first().id == 1


def test_symbols_need_all_words_and_rank_by_density(spark):
    rows = [(1, "r", "a.js", "alpha", "function", 1, "alpha()", "beta x gamma"), (2, "r", "b.js", "betaOnly", "function", 1, "sig", "beta"), (3, "r", "c.js", "two", "function", 1, "beta gamma", None), (4, "r", "d.js", "Beta Gamma", "class", 1, None, None), (5, "r", "e.js", "my beta gamma thing", "class", 1, None, None)]
    s = spark.createDataFrame(rows, "id int, repo string, file_path string, symbol_name string, symbol_type string, start_line int, signature string, content string")
    got = [(r.id, round(r.similarity, 6)) for r in ranking.symbol_search(s, "beta gamma").collect()]
    assert got == [(4, 1.0), (5, 0.85), (3, 0.1), (1, 0.05)]
    assert [r.id for r in ranking.symbol_search(s, "!!").collect()] == [] and ranking.symbol_search(s, " ").count() == 0
    assert FILLERS and py_split_camel("aB") == "a B"
