import hashlib
import math
import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import hashing, paths, text, vector
from lodestone.operators import filters
from lodestone.sources import files, formats


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def many(spark, values, column):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").select("i", column.alias("x")).orderBy("i").collect()]


def test_subtokens(spark):
    assert many(spark, ["searchBlobs", "episode-rollup.js", "`HTTPServer_v2`", "a", ""], text.subtokens(F.col("c"))) == [["searchblobs", "search", "blobs"], ["episode", "rollup", "js"], ["httpserver", "http", "server", "v2"], [], []]


def test_stem_and_terms(spark):
    words = ["queries", "boxes", "class", "status", "analysis", "rollups", "cat", "ties", "searches"]
    assert many(spark, words, text.light_stem(F.col("c"))) == [text.py_light_stem(w) for w in words] == ["query", "box", "class", "status", "analysis", "rollup", "cat", "tie", "search"]
    assert text.query_terms("how to find the HTTPServer") == ["find", "http", "server"]
    assert text.query_terms("the and") == ["the", "and"]


def test_shapes(spark):
    tokens = ["fooBar", "FooBar", "Foo", "foo_bar", "foo-bar", "pool.query", "e.g", "v1.2.3", "src/a", "and/or", "a/b/c", "plain"]
    assert many(spark, tokens, text.code_shape(F.col("c"))) == ["camel", "pascal", None, "snake", "kebab", "dotted", None, None, "path", None, "path", None]


def test_hit_ratio_and_covers(spark):
    assert many(spark, ["the HttpServer here", "rollup only", "none"], text.hit_ratio(F.col("c"), "server rollups")) == [0.625, 0.625, None]
    assert many(spark, ["entries", "entry", "foo_bar", "x"], text.count_covered(F.col("c"), ["entries", "foobar"])) == [1, 1, 1, 0]


def test_compact_tokens(spark):
    got = one(spark, text.compact_tokens(F.lit("const alpha = beta(alpha); return gamma"), F.lit("fn x()")))
    assert got == "fn x()\nalpha beta gamma"


def test_calibration(spark):
    xs = [0.10, 0.25, 0.80, 0.0, 1.0, 0.5]
    got = [r.x for r in spark.createDataFrame([(x,) for x in xs], "v double").select(vector.calibrate(F.col("v")).alias("x")).collect()]
    assert got == pytest.approx([0.30, 0.52, 0.92, 0, 1, 0.68 + 0.12 / 0.22 * 0.16])
    assert one(spark, vector.calibrate(F.lit(0.25), "other")) == 0.25
    assert one(spark, vector.calibrate(F.lit(0.25), sparse=vector.is_sparse(F.array(F.lit(1.0), *[F.lit(0.0)] * 40)))) == 0.25


def test_vectors(spark):
    v = one(spark, vector.deterministic(F.lit("hello world"), 1024))
    assert len(v) == 1024 and math.sqrt(sum(x * x for x in v)) == pytest.approx(1, abs=1e-4) and v[:16] == v[16:32]
    bad = spark.createDataFrame([([1.0] * 4,), ([1.0] * 3,), ([1.0, float("nan"), 0.0, 0.0],), ([1.0, float("inf"), 0.0, 0.0],)], "v array<double>")
    assert [r.x is not None for r in bad.select(vector.validated(F.col("v"), 4).alias("x")).collect()] == [True, False, False, False]
    assert many(spark, ["Ollama/X:latest", "models/ollama/y:4b", "", None], vector.canonical_model(F.col("c"))) == ["x", "y:4b", vector.DEFAULT_MODEL, vector.DEFAULT_MODEL]
    assert many(spark, ["find it", "query: find it"], vector.query_input(F.col("c"))) == ["query: find it"] * 2
    rows = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, [5.0, 5.0]), (3, [1.0, 0.0]), (3, [-1.0, 0.0])], "k int, v array<double>")
    got = {r.k: r.centroid for r in vector.centroid(rows, ["k"], "v").collect()}
    assert got == {1: [0.6, 0.8], 2: [5.0, 5.0], 3: [0.0, 0.0]}


def test_chunks(spark):
    body = "".join(chr(97 + i % 26) for i in range(3000))
    got = one(spark, vector.chunks(F.lit(body), F.lit("[r :: p]\n")))
    size = 1100 - 9
    want, start = [], 0
    while start < len(body):
        want.append("[r :: p]\n" + body[start : start + size])
        if start + size >= len(body):
            break
        start += size - 150
    assert got == want
    assert len(one(spark, vector.chunks(F.repeat(F.lit("a"), 10**5), F.lit("")))) == vector.MAX_CHUNKS


def test_hashes(spark):
    assert one(spark, hashing.blob_hash(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, hashing.symbol_hash(F.lit(" a\r\nb \n"))) == hashlib.sha256(b"a\nb").hexdigest()
    body = "blob 1 a\ntree 2 b"
    entries = F.array(F.struct(F.lit("b").alias("name"), F.lit("tree").alias("type"), F.lit("2").alias("object_id")), F.struct(F.lit("a").alias("name"), F.lit("blob").alias("type"), F.lit("1").alias("object_id")))
    assert one(spark, hashing.tree_hash(entries)) == hashlib.sha1(f"tree {len(body)}\0{body}".encode()).hexdigest()


PATHS = st.lists(st.sampled_from(["..", ".", "a", "b.js", ""]), min_size=1, max_size=6).map("/".join).filter(lambda p: not p.startswith("/"))


@settings(max_examples=15, deadline=None)
@given(st.lists(PATHS, min_size=1, max_size=30))
def test_normalise(spark, values):
    want = [("" if (n := posixpath.normpath(p)) == "." else n) for p in values]
    assert many(spark, values, paths.normalise(F.col("c"))) == want


def test_path_parts(spark):
    p = ["src/a.test.js", "index.ts", "lib/index.js", ".env", "a/b"]
    assert many(spark, p, paths.extname(F.col("c"))) == [".js", ".ts", ".js", "", ""]
    assert many(spark, p, paths.dirname(F.col("c"))) == ["src", ".", "lib", ".", "a"]
    assert many(spark, p, paths.whole_names(F.col("c"))) == [["src/a.test.js", "src/a", "src/a.test"], ["index.ts", "index"], ["lib/index.js", "lib", "lib/index"], [".env"], ["a/b"]]


def test_filters(spark):
    p = ["src/a.js", "node_modules/x.js", "my-venv-1/a.py", "a/dist/b", "pkg.egg-info/x"]
    assert many(spark, p, filters.is_walked(F.col("c"))) == [True, False, False, False, False]
    assert many(spark, ["x" * 6000, "short", "data:image/png;base64,aaaaaaaa", "a\nb\nc" * 20], filters.looks_binary(F.col("c"))) == [True, True, True, False]
    assert many(spark, ["a.JS", "b.bin", "Dockerfile"], filters.is_embeddable(F.col("c"))) == [True, False, False]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"\0\1" * 10)
    (tmp_path / "node_modules/c.js").write_text("x")
    got = {r.file_path: r for r in files.working_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.py", "src/b.bin"} and got["src/b.bin"].content is None
    assert got["src/a.py"].id == hashlib.sha1(b"blob 22\0def f():\n    return 1\n").hexdigest()
    tree = files.tree_entries(spark.createDataFrame([("a.txt", "1"), ("d/b.txt", "2"), ("d/e/c.txt", "3")], "file_path string, id string")).collect()
    assert {(r.dir, r.name, r.type) for r in tree} == {(".", "a.txt", "blob"), (".", "d", "tree"), ("d", "b.txt", "blob"), ("d", "e", "tree"), ("d/e", "c.txt", "blob")}
    log = spark.createDataFrame([("a" * 40 + "|" + "b" * 40 + " " + "c" * 40 + "|Ann|fix | it",), ("bad|x|y|z",)], "value string")
    assert [tuple(r) for r in files.git_log(log).collect()] == [("a" * 40, "b" * 40, "Ann", "fix | it")]
    where = many(spark, ["src/a.js", "../x", "/etc/p", "a/../../b", "a\0b"], files.pointer_path(F.lit("/root/proj"), F.col("c")))
    assert where == ["proj/src/a.js", None, "proj/etc/p", None, None]
    assert one(spark, files.snippet(F.lit("1\n2\n3\n4"), F.lit(2), F.lit(3))) == "2\n3"


def test_formats(spark):
    row = spark.createDataFrame([("fix", None, "old", None, "a.py", None)], "subject string, message string, old_contents string, new_contents string, old_file string, new_file string")
    assert formats.commit_packs(row).first()["text"] == "Commit Message:\nfix\n\nFile: a.py\n\nBefore:\nold\n\nAfter:\n(deleted)"
    turns = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, None, "a")], "conv_id int, turn int, role string, text string")
    assert formats.trajectories(turns).first()["text"] == "[UNKNOWN]\na\n\n[USER]\nb"
    got = many(spark, ['```json\n{"summary": "S", "tags": ["a", "b"]} x\n```', "no"], formats.tagged_summary(F.col("c")))
    assert got == ["S [a, b]", None]
    doc = "\n".join(["# A"] + ["x" * 99] * 5 + ["## B", "y"])
    assert one(spark, formats.markdown_parts(F.lit(doc), 300)) == ["# A\n" + ("x" * 99 + "\n") * 5, "## B\ny\n"]
