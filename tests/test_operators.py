import json
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import text
from lodestone.operators import graph, ranking, upserts, versions
from lodestone.plans import catalogue, views
from lodestone.streaming import ingest

SF = "/root/testdata/sf0.001"
AS_OF = datetime(2024, 2, 1)
#: One query per family; the driver compares all of them.
SPOT = ["hybrid_search_rrf", "latest_version_window", "resolved_imports", "bridge_scores", "chunk_windows", "upsert_blobs", "tree_walk", "subtoken_split", "symbol_search_words", "keyword_search_words", "bridge_edge_symbols", "snapshot_changes"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SPOT)
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want))


def test_catalogue_has_oracles():
    assert len(catalogue.QUERIES) >= 60 and set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"ann_neighbours"}


def blobs(spark):
    unit, other = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (1, "r", "a/rollup.js", "rollup.js", "episode rollup", None, "x", datetime(2024, 1, 1), None, "active", unit),
        (2, "r", "a/rollup.js", "rollup.js", "episode rollup", None, "x", datetime(2024, 1, 20), None, None, unit),
        (3, "r", None, "loose.js", "nothing", None, "x", datetime(2024, 1, 10), None, "active", unit),
        (4, "r", "b.js", "b.js", "other", None, "x", datetime(2024, 1, 31), None, "legacy", unit),
        (5, "r", "c.js", "c.js", "other", None, "x", datetime(2024, 1, 31), None, "active", other),
    ]
    return spark.createDataFrame(rows, "id long, repo string, file_path string, file_name string, summary string, symbol_spine string, content string, last_seen_at timestamp_ntz, created_at timestamp_ntz, embed_model string, embedding array<double>")


def test_retrieval_drops_shadows_and_foreign_models(spark):
    b = blobs(spark)
    assert [r.id for r in ranking.dense_search(b, [1.0, 0.0], AS_OF).collect()] == [2, 3, 5]
    assert [r.id for r in ranking.keyword_search(b, "episodes rollups", AS_OF).collect()] == [2]
    top = ranking.hybrid_search(b, "episode rollups", [1.0, 0.0], AS_OF).first()
    assert top.id == 2 and top.similarity == pytest.approx(2 / 61 * 2.718281828 ** (-0.12), rel=1e-6)
    assert ranking.search(b, AS_OF, "loose.js").first().id == 3
    for bad in ({"query_text": None}, {"query_text": "x", "k": 0}, {"query_text": "x", "k": True}):
        with pytest.raises(TypeError):
            ranking.search(b, AS_OF, **bad)


def test_decay(spark):
    days = [0, 30, 100]
    rows = spark.createDataFrame([(i, datetime.fromordinal(AS_OF.toordinal() - d)) for i, d in enumerate(days)], "i int, t timestamp_ntz").withColumn("n", F.lit(None).cast("timestamp_ntz"))
    got = [r.x for r in rows.orderBy("i").select((0.95 * F.exp(-0.01 * ranking.age_days(AS_OF, "t", "n"))).alias("x")).collect()]
    assert got == pytest.approx([0.95, 0.95 * 0.7408182, 0.95 * 0.3678794])


def test_both_latest_forms_agree(spark):
    b = views.blobs(spark, SF)
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    assert ids(versions.latest_by_window(b)) == ids(versions.latest_by_antijoin(b))


def test_resolution(spark):
    edges = [(1, "src/a.js", "./b"), (2, "src/a.js", "../lib/c.js"), (3, "src/a.js", "node:fs"), (4, "src/x/y.js", "../index"), (5, "src/a.js", "c"), (6, "src/a.js", "utils"), (7, "src/a.js", "./d"), (8, "a.js", "../../z/c.js"), (9, "src/a.js", "@s/c"), (10, "src/a.js", "lib/c")]
    files = ["src/b.test.js", "lib/c.js", "src/index.ts", "lib/utils.js", "src/d/index.js", "src/a.js", "z/c.js"]
    e = spark.createDataFrame([(i, "r", s, t, "imports") for i, s, t in edges], "id int, repo string, source_path string, target_path string, relation string")
    f = spark.createDataFrame([("r", p) for p in files] + [("other", "src/b.js"), ("r", None)], "repo string, file_path string")
    got = sorted((r.id, r.file_path) for r in graph.resolve(e, f).collect())
    assert got == [(1, "src/b.test.js"), (2, "lib/c.js"), (4, "src/index.ts"), (5, "lib/c.js"), (5, "z/c.js"), (7, "src/d/index.js"), (8, "z/c.js"), (10, "lib/c.js")]


def test_merge_protects_the_top():
    cover = lambda r: r["t"]
    row = lambda n, x, t, bridge=False: {"n": n, "similarity": x, "t": t, "bridge": bridge}
    names = lambda rows: [r["n"] for r in rows]
    hop1 = [row(i, 1 - i / 10, 1) for i in range(3)]
    strong, weak = row(9, 0.5, 2, True), row(8, 0.4, 0, True)
    assert names(graph.merge_bridges(hop1, [strong, weak], 3, cover)) == [0, 1, 9]
    assert names(graph.merge_bridges(hop1, [strong], 9, cover)) == [0, 1, 2, 9]
    # with room left bridges only fill it, even where they hold more than a row, and all sort by similarity
    assert names(graph.merge_bridges(hop1, [row(7, 0.95, 5, True), strong], 4, cover)) == [0, 7, 1, 2]
    # of the open rows the one with fewest tokens goes, then the least similar, then the last; the result is sorted
    assert names(graph.merge_bridges([row(0, 0.9, 0), row(1, 0.8, 2), row(2, 0.7, 1), row(3, 0.6, 3)], [strong], 4, cover)) == [0, 1, 3, 9]
    assert names(graph.merge_bridges([row(0, 0.9, 0), row(1, 0.5, 1), row(2, 0.5, 1)], [row(9, 0.8, 2, True)], 3, cover)) == [0, 9, 1]
    assert names(graph.merge_bridges([row(0, 0.9, 0)], [strong], 1, cover)) == [0]
    assert names(graph.merge_bridges(hop1, [strong, row(7, 0.45, 2, True), row(6, 0.44, 9, True)], 3, cover)) == [0, 9, 7]


def test_seeds_come_by_rank(spark):
    rows = [("r", "c.js", 2), ("r", "/a.js", 0), ("r", "a.js", 1), ("r", None, 3), ("s", "a.js", 5), ("r", "z.js", 9), (None, "q.js", 1)]
    got = graph.first_seeds(spark.createDataFrame(rows, "repo string, file_path string, rank int")).collect()
    assert sorted((r["repo"], r["seed_path"], r["rank"]) for r in got) == [("r", "a.js", 0), ("r", "c.js", 2), ("s", "a.js", 5)]


def test_deep_walks(spark):
    """Twenty rounds: plans are cut, so time follows the rounds."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(5, 0)], "src int, dst int")
    got = {r.node: r.depth for r in graph.walk(chain, spark.createDataFrame([(0,)], "node int"), 20).collect()}
    assert got == {i: i for i in range(21)}
    tree = spark.createDataFrame([(f"t{i}", f"d{i}", f"t{i + 1}") for i in range(20)], "tree_id string, name string, object_id string")
    out = graph.descend(tree, "t0").collect()
    assert max(r.depth for r in out) == 20 and len(out) == 20 and max(out, key=lambda r: r.depth).path.count("/") == 19
    with pytest.raises(ValueError):
        graph.descend(tree.union(spark.createDataFrame([("t20", "again", "t0")], tree.schema)), "t0", 30)
    commits = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "id int, parent_id int")
    got = graph.ancestors(commits, commits.where("id in (99, 3)").select("id")).collect()
    assert sorted((r["head"], r["id"], r["generation"]) for r in got) == sorted([(99, 99 - g, g) for g in range(100)] + [(3, 3 - g, g) for g in range(4)])
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent_id int"), commits.where("id = 1").select("id"), 50)


def test_plans_stay_small(spark):
    e = spark.createDataFrame([(1, "r", "a.js", "./b", "imports")], "id int, repo string, source_path string, target_path string, relation string")
    f = spark.createDataFrame([("r", "b.js")], "repo string, file_path string")
    assert len(graph.resolve(e, f)._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_query_identifiers(spark):
    names, tokens = text.query_identifiers("Where does `pool.query` use searchBlobs() in lib/embedding.js, e.g. the `FooBar`?", spark)
    assert names == ["pool.query", "FooBar", "searchBlobs", "lib/embedding.js"]
    assert tokens == ["pool", "query", "searchblobs", "search", "blobs", "lib", "embedding", "js", "foobar", "foo", "bar"]
    assert text.query_identifiers("the of", spark) == ([], [])


def test_symbol_supplement(spark):
    rows = [(1, "r", "a.js", "rollUp", "function", 1, "active", [1.0, 0.0]), (2, "r", "b.js", "other", "function", 1, "active", [0.9, 0.1]), (3, "r", "c.js", "far", "function", 1, "active", [0.0, 1.0])]
    s = spark.createDataFrame(rows, "id int, repo string, file_path string, symbol_name string, symbol_type string, start_line int, embed_model string, embedding array<double>")
    s = s.select("*", F.lit("sig").alias("signature"), F.lit("body").alias("content"))
    ids = lambda q, v, k=5: [r.id for r in ranking.symbol_search_with_meaning(s, q, v, k).orderBy("place").collect()]
    assert ids("rollup", [1.0, 0.0]) == [1] and ids("rollup now", [1.0, 0.0]) == [1, 2] and ids("nothing", [1.0, 0.0]) == [1, 2]
    assert ids("nothing", None) == [] and ids("rollup now", [1.0, 0.0], 1) == [1]


def test_repository_names(spark):
    e = Engine(spark.createDataFrame([(1, "me/Tool", AS_OF), (2, "1", AS_OF)], "id int, name string, created_at timestamp_ntz"), None, None, None)
    assert [e.resolve_repo(x) for x in ("me/Tool", "1", 2, "ME/tool", "tool", "you/TOOL")] == ["me/Tool", "1", "1", "me/Tool", "me/Tool", "me/Tool"]


def test_writes(spark):
    b = blobs(spark)
    assert upserts.insert_absent(b, b).count() == 5
    with pytest.raises(ValueError):
        upserts.create_repository(spark.createDataFrame([(1, "r", None, AS_OF)], "id int, name string, description string, created_at timestamp_ntz"), "r", None, AS_OF)
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 1), (4, None, 1)], "id int, k string, l int")
    assert sorted(r.id for r in versions.drop_exact_duplicates(rows, ["k", "l"]).collect()) == [2, 3, 4]


def test_engine(spark):
    b = blobs(spark)
    repos = spark.createDataFrame([(1, "r", AS_OF)], "id int, name string, created_at timestamp_ntz")
    symbols = spark.createDataFrame([(1, "r", "a/rollup.js", "rollUp", "function", 1, 2, "function rollUp()", "x", 1)], "id int, repo string, file_path string, symbol_name string, symbol_type string, start_line int, end_line int, signature string, content string, blob_id int")
    edges = spark.createDataFrame([(1, "r", "b.js", "./a/rollup.js", "imports"), (2, "r", "a/rollup.js", "pg", "requires")], "id int, repo string, source_path string, target_path string, relation string")
    e = Engine(repos, b, symbols, edges)
    assert e.read_blob("/a/rollup.js", repo=1).first().id == 2
    assert e.search_symbols("ROLLUP").first().similarity == 1.0
    g = e.symbol_graph("rollup")
    assert [g[k].count() for k in ("symbols", "imports", "dependents")] == [1, 1, 1]
    assert e.semantic_search("episode", [1.0, 0.0], AS_OF, k=99).count() == 3
    assert e.semantic_search("episode", [1.0, 0.0], AS_OF, k=99, bridges=True).select("id", "bridge", "via").count() == 3
    with pytest.raises(ValueError):
        e.read_blob("x", repo="none")


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    row = lambda p, c: json.dumps({"repo": "r", "file_path": p, "content": c, "seen_at": "2024-01-01T00:00:00Z"})
    for i, rows in enumerate([[row("a.py", "def f():\n    return 1\n"), row("b.py", "def f():\n    return 1\n")], [row("c.py", "def f():\n    return 1\n"), row("d.py", "def g():\n    return 2\n"), row("node_modules/e.py", "def h():\n    pass\n")]]):
        (src / f"{i}.json").write_text("\n".join(rows))
        ingest.start(spark, ingest.new_blobs(ingest.read(spark, str(src))), str(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/blobs").count() == 2
    assert sorted(r.symbol_name for r in spark.read.parquet(f"{out}/symbols").collect()) == ["f", "g"]


def test_tool_lines_leave_out_what_is_missing(spark):
    from lodestone.operators import answers

    rows = spark.createDataFrame([(0.5, None, "r", "f.js", None, None, ""), (0.1234, "a.js", None, "g.js", "src/g.js", None, "text")], "similarity double, via string, repo string, file_name string, file_path string, last_seen_at timestamp_ntz, summary string")
    got = [r[0] for r in rows.select(answers.match_text()).collect()]
    assert got == ["--- Match (Score: 0.500) | [r] f.js | Seen: unknown ---\n(no preview)", "--- Match (Score: 0.123) [Graph Bridge via a.js] |  g.js | Path: src/g.js | Seen: unknown ---\ntext"]
    symbols = spark.createDataFrame([(None, "p", 1, 2, "class", "A", None, None, None)], "repo string, file_path string, start_line int, end_line int, symbol_type string, symbol_name string, symbol_hash string, signature string, content string")
    assert tuple(symbols.select(answers.symbol_text(), answers.declared_text()).first()) == ("--- p:1-2 | CLASS: A ---", "• L1-L2 [class] A: ")


def test_vectors_written_back_with_and_without_a_model(spark):
    schema = "id int, embedding array<double>, embed_model string"
    old = spark.createDataFrame([(1, None, None), (2, [1.0], "a"), (3, [3.0], "a")], schema)
    new = spark.createDataFrame([(1, [9.0]), (2, None), (7, [7.0])], "id int, embedding array<double>")
    rows = lambda model: sorted(tuple(r) for r in upserts.write_vectors(old, new, model).collect())
    assert rows("b") == [(1, [9.0], "b"), (2, [1.0], "a"), (3, [3.0], "a")]
    assert rows(None) == [(1, [9.0], None), (2, [1.0], "a"), (3, [3.0], "a")]
