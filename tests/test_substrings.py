"""The trigram index, many identifiers in one pass, vectors in batches, and the text of the dependency tool."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, embedding, filters, patterns, substrings

TEXTS = ["The Quick brown fox", "quick", "", None, "ÉCOLE été 𝒳𝒴𝒵 fin", "aaaaaa", "the quick brown fox", "x", "qu", "a\nb\tc % _ \\", "𝒳"]


def texts(spark, extra=400):
    made = random.Random(3)
    more = ["".join(made.choice("abcé 𝒳") for _ in range(made.randint(0, 60))) for _ in range(extra)]
    rows = [(i, t) for i, t in enumerate(TEXTS + more)] + [(0, "another text of the first id"), (None, "quick without an id"), (1, "quick")]
    return rows, spark.createDataFrame(rows, "id int, text string")


def scan(rows, needles):
    return sorted((n, i) for n in {n.lower() for n in needles if n} for i, t in rows if i is not None and t and n in t.lower())


@pytest.mark.parametrize("few", [100_000, 0])
def test_trigram_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(substrings, "SEGMENT", 50)
    monkeypatch.setattr(substrings, "FEW", few)
    rows, table = texts(spark)
    made = random.Random(5)
    needles = [None, "", "q", "QU", "qui", "Quick", "quick brown", "É", "ÉCOLE", "𝒳", "𝒳𝒴", "𝒳𝒴𝒵", "aaaa", "% _", "\\", "zzz", "zzzz", "aaaz", "quick"]
    needles += [t[p : p + made.randint(1, 7)] for _, t in made.sample(rows[11:-3], 30) if t for p in [made.randint(0, len(t) - 1)]]
    index = substrings.build(table, f"{tmp_path}/index")
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = sorted((r.needle, r.id) for r in index.search(asked, table).collect())
    assert got == scan(rows, needles)
    assert index.ids.count() > 3


@pytest.mark.parametrize("candidates", [0, 1, 1000])
def test_trigram_counts_leave_frequent_needles_to_one_pass(spark, tmp_path, monkeypatch, candidates):
    monkeypatch.setattr(substrings, "SEGMENT", 50)
    monkeypatch.setattr(substrings, "CANDIDATES", candidates)
    rows, table = texts(spark)
    made = random.Random(6)
    needles = ["q", "quick", "ÉCOLE", "aaaa", "zzz", "", None] + [t[p : p + made.randint(3, 6)] for _, t in made.sample(rows[11:-3], 60) if t for p in [made.randint(0, len(t) - 1)]]
    index = substrings.build(table, f"{tmp_path}/index")
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    looked, scanned = index._split(index._chosen(substrings._folded(asked)))
    held = index.ids.select(F.sum(F.size("ids"))).first()[0]
    assert (looked.agg(F.sum("least")).first()[0] or 0) <= candidates * held
    assert (scanned is None) == (candidates == 1000)
    pairs = scan(rows, needles)
    told = sorted((n, sum(x == n for x, _ in pairs), min(i for x, i in pairs if x == n)) for n in {n for n, _ in pairs})
    assert sorted((r.needle, r.n_rows, r.first_id) for r in index.counts(asked, table).collect()) == told
    assert sorted((r.needle, r.id) for r in index.search(asked, table).collect()) == pairs


def test_patterns_share_one_automaton_and_tally_the_least_ids(spark):
    many = spark.range(120_000).select(F.concat(F.lit("Pat"), F.col("id").cast("string")).alias("pattern"))
    assert len(list(patterns._parts(many, patterns.PART))) == 1
    rows = [(5, "PAT7 pat77"), (3, "pat7"), (None, "pat7 pat9"), (4, None), (9, "pat9"), (2, "")]
    table = spark.createDataFrame(rows, "id int, text string").repartition(3)
    asked = spark.createDataFrame([("pat7",), ("PAT77",), ("pat9",), ("none",), ("",), (None,), ("Pat7",)], "pattern string")
    expected = [("pat7", 3, 3), ("pat77", 1, 5), ("pat9", 2, 9)]
    for part in (1, patterns.PART):
        assert sorted(tuple(r) for r in patterns.tallies(table, asked, part).collect()) == expected


def test_candidates_are_few(spark, tmp_path):
    """Candidates of fifty needles are at most ten times the hits."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id as id", "text")
    needles = d.where("id % 20 = 0").selectExpr("substr(text, 41, 8 + id % 5) as needle").where("length(needle) > 7")
    index = substrings.build(d, f"{tmp_path}/index")
    hits = index.search(needles, d).count()
    assert needles.count() <= hits <= index.candidates(needles).count() <= 10 * hits


def test_trigram_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = substrings.build(none, f"{tmp_path}/index")
    assert index.search(spark.createDataFrame([("abc",), ("a",)], "needle string"), none).collect() == []
    rows, table = texts(spark, 0)
    index = substrings.build(table, f"{tmp_path}/some")
    assert index.search(spark.createDataFrame([], "needle string"), table).collect() == []


@pytest.mark.parametrize("part", [50_000, 7])
def test_patterns_equal_a_scan(spark, part):
    rows, table = texts(spark)
    made = random.Random(7)
    asked = [None, "", "quick", "Quick", "uick", "ick", "é", "École", "nowhere", "𝒳𝒴", "aa", "aaa"] + ["".join(made.choice("abcé") for _ in range(made.randint(1, 4))) for _ in range(40)]
    folded = {p.lower() for p in asked if p}
    p = spark.createDataFrame([(x,) for x in asked], "pattern string")
    expected = sorted((p, i) for p in folded for i, t in rows if t and p in t.lower() if i is not None)
    assert sorted((r.pattern, r.id) for r in patterns.holders(table.where("id is not null"), p, part).collect()) == expected
    counted = {p: n for p in folded if (n := sum(bool(t) and p in t.lower() for _, t in rows))}
    assert {r.pattern: r.n_rows for r in patterns.counts(table, p, part).collect()} == counted
    assert {r.pattern for r in patterns.unattested(table, p, part).collect()} == folded - set(counted)


def test_patterns_of_nothing(spark):
    rows, table = texts(spark, 0)
    none = spark.createDataFrame([(None,), ("",)], "pattern string")
    assert patterns.holders(table, none).collect() == [] and patterns.counts(table, none).collect() == []
    one = spark.createDataFrame([("quick",)], "pattern string")
    assert [r.pattern for r in patterns.unattested(table.limit(0), one).collect()] == ["quick"]


class Flaky:
    """Refuses batches over a size, overflows over a length, always fails on some texts, and has no vector for others."""

    def __call__(self, batch):
        if any(len(t) > 100 for t in batch):
            raise embedding.Overflow
        if len(batch) > 9 or any("bad" in t for t in batch):
            raise OSError("refused")
        return [None if "none" in t else [float(len(t)), float(ord(t[0]))] for t in batch]


def alone(text):
    """What a text gets by itself."""
    if text is None or not text.strip():
        return None, 0, 0, "blank"
    halvings = 0
    while len(text) > 100 and halvings < embedding.HALVINGS:
        text, halvings = text[: len(text) // 2], halvings + 1
    if len(text) > 100:
        return None, 0, halvings, "overflow"
    if "bad" in text:
        return None, 0, halvings, "overflow" if halvings else "failed"
    return (None if "none" in text else [float(len(text)), float(ord(text[0]))]), len(text), halvings, "failed" if "none" in text else "ok"


def test_batches_keep_every_place_through_failures(spark):
    made = random.Random(11)
    bodies = [None, "", " \n", "bad", "none here", "y" * 1600, "y" * 1601, "z" * 3000, "bad" + "q" * 300] + [made.choice(["a", "bad ", "none ", "ü"]) * made.randint(1, 90) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(bodies)), "id int, text string").repartition(3)
    got = {r.id: (r.vector, r.used, r.halvings, r.status) for r in embedding.embed(table, "id", "text", Flaky(), budget=600).collect()}
    assert got == {i: alone(t) for i, t in enumerate(bodies)}
    assert embedding.embed(table.limit(0), "id", "text", Flaky()).collect() == []


def test_calls_are_near_the_fewest(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lengths = [len(r.text or "") for r in d.collect()]
    calls = embedding.plan(lengths, 24, 20_000)
    assert sorted(i for c in calls for i in c) == list(range(len(lengths)))
    assert all(len(c) <= 24 and (len(c) == 1 or len(c) * max(lengths[i] for i in c) <= 20_000) for c in calls)
    fewest = max(-(-len(lengths) // 24), -(-sum(lengths) // 20_000))
    assert len(calls) <= 1.25 * fewest + 1
    out = embedding.embed(d.coalesce(1), "doc_id", "text", embedding.stand_in(4, 10**9), budget=20_000)
    assert out.agg(F.sum("calls")).first()[0] <= len(calls)


def test_queue_and_files_taken(spark):
    rows = [(1, "a.txt", 40, None, "x", "r"), (2, "b.py", 90, None, "x", "r"), (3, "c.py", 80, None, "x", "s"), (4, "d.py", 30, None, "x", "r"), (5, "e.py", 50, "s", "x", "r"), (6, "f.py", 80, None, None, "r"), (7, None, 31, None, "x", "r"), (8, "g.py", 90, None, "x", "r")]
    b = spark.createDataFrame(rows, "id int, file_name string, size int, summary string, content string, repo string")
    assert [r.id for r in filters.tag_queue(b).collect()] == [3, 2, 8, 7, 1]
    assert [r.id for r in filters.tag_queue(b, 2, ("r",)).collect()] == [2, 8]
    p = spark.createDataFrame([("a/b.js",), ("a",), ("ab/c.js",), ("x/a/c.js",), ("x/colors.ts",), ("x/build/c.js",), (None,)], "path string")
    assert [r.t for r in p.select(filters.is_taken(F.col("path"), ("a/",)).alias("t")).collect()] == [False, False, True, True, False, False, False]


def test_text_of_dependencies(spark):
    symbols = spark.createDataFrame([(1, "run", "function", 3, 9, "abcdef0123456789", "def run()"), (2, "Run", "class", 1, 2, None, None)], "id int, symbol_name string, symbol_type string, start_line int, end_line int, symbol_hash string, signature string")
    edges = spark.createDataFrame([(1, "a.js", "b.js", "imports", ["x", "y"]), (2, "a.js", "c.js", "requires", [])], "id int, source_path string, target_path string, relation string, symbols array<string>")
    parts = {"symbols": symbols, "imports": edges, "dependents": edges.limit(0)}
    lines = [r.line for r in answers.dependency_lines("a.js", parts, "RUN").orderBy("section", "place").collect()]
    assert lines == [
        "=== 🕸️ Dependency Graph for a.js (focus: RUN) ===", "🎯 Target Symbol Definition:", "  • [CLASS] Run (L1-L2)", "  • [FUNCTION] run (L3-L9) | hash:abcdef012345 | def run()",
        "📦 Declared Symbols (2):", "  • [class] Run (L1-L2)", "  • [function] run (L3-L9) [hash:abcdef012345]", "➡️ Outbound Imports (2):", "  • imports: b.js [x, y]", "  • requires: c.js", "⬅️ Inbound Dependents (0):", "  (none)",
    ]
    assert answers.dependency_lines("a.js", parts, "other").where("section = 1").collect() == []
