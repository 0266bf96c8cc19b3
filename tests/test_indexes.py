"""The vector index, strong components, Merkle comparison, bridges over the symbols of edges."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, graph, ranking, snapshots
from tests import samples
from tests.test_operators import AS_OF, blobs


def exact_neighbours(spark, path, k):
    e = spark.read.parquet(path).selectExpr("vec_id as id", "embedding as vector")
    rows = e.collect()
    x = ann.unit(np.array([r.vector for r in rows], float))
    asked = [i for i, r in enumerate(rows) if r.id % 20 == 0]
    exact = {rows[i].id: {rows[j].id for j in np.argsort(-(x @ x[i]), kind="stable")[:k]} for i in asked}
    return e, exact


@pytest.mark.parametrize(("table", "k", "rerank"), [("/root/testdata/sf0.01/embeddings.parquet", 10, 100), ("/root/testdata/sf0.1/embeddings.parquet", 150, 399)])
def test_vector_index_recall(spark, tmp_path, monkeypatch, table, k, rerank):
    """Every vector whose id is divisible by 20 against all rows; under a fifth of the vectors are read for a query."""
    monkeypatch.setattr(ann, "PART_ROWS", 20)
    monkeypatch.setattr(ann, "PART_QUERIES", 7)
    e, exact = exact_neighbours(spark, table, k)
    assert rerank * 5 <= e.count()
    found = ann.build(spark, e, f"{tmp_path}/index").search(e.where("id % 20 = 0").selectExpr("id as query_id", "vector"), k, rerank).collect()
    assert len(found) == k * len(exact) and {(r.query_id, r["rank"]) for r in found} == {(q, n) for q in exact for n in range(1, k + 1)}
    assert sum(r.id in exact[r.query_id] for r in found) >= 0.95 * len(found)
    first = {r.query_id: (r.id, round(r.cosine, 9)) for r in found if r["rank"] == 1}
    assert all(first[q] == (q, 1.0) for q in exact)


def test_a_query_goes_once_to_a_shard_however_many_cells_it_visits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    model = ann.Model.fit(x, 10_000)  # 100 cells
    batch = pa.record_batch([pa.array(range(30)), pa.array(x[:30].tolist())], ["query_id", "vector"])
    (out,) = ann._visits(model, 90)(iter([batch]))
    assert out.num_rows <= 30 * ann.SHARDS < 30 * 90
    cells = model.visited(ann.unit(x[:30]), 90)
    told = {q: [] for q in range(30)}
    for r in out.to_pylist():
        assert {c % ann.SHARDS for c in r["cells"]} == {r["shard"]}
        told[r["query_id"]] += r["cells"]
    assert {q: sorted(c) for q, c in told.items()} == {q: sorted(c) for q, c in enumerate(cells.tolist())}
    cell, code = model.code(x)
    inside = np.flatnonzero(cell % ann.SHARDS == 3)
    rows = pa.table({"cell": cell[inside].astype(np.int32), "id": inside, "code": [c.tobytes() for c in code[inside]]})
    asked = pa.Table.from_batches([out]).filter(pc.equal(out.column("shard"), 3))
    got = ann._score(model, 5)(rows, asked).to_pylist()
    for r in asked.to_pylist():
        q = ann.unit(np.array([r["vector"]]))
        best = sorted((model.scores(q, c, code[[i]])[0, 0] for i, c in enumerate(cell) if c in r["cells"]), reverse=True)[:5]
        assert np.allclose(sorted((g["estimate"] for g in got if g["query_id"] == r["query_id"]), reverse=True), best)


def test_vector_index_of_awkward_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [None, 1.0]), (2, [0.9, 0.1])]
    table = spark.createDataFrame(rows, "id int, vector array<double>")
    index = ann.build(spark, table, f"{tmp_path}/index")
    got = [(r.query_id, r["rank"], r.id) for r in index.search(table.selectExpr("id as query_id", "vector").where("query_id in (1, 4, 6, 8)"), 9).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 3)]
    assert index.search(table.selectExpr("id as query_id", "vector").limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        ann.build(spark, table.where("id > 3 and id < 8"), f"{tmp_path}/none")


def test_dense_search_by_the_vector_index(spark, tmp_path):
    b = blobs(spark)
    index = ranking.vector_index(b, f"{tmp_path}/index")
    assert ranking.dense_search(b, [1.0, 0.0], AS_OF, near=index).collect() == ranking.dense_search(b, [1.0, 0.0], AS_OF).collect()


def plain_components(edges):
    nodes = {x for e in edges for x in e if x is not None}
    reach = {n: {n} for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a is None or b is None:
                continue
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    moved = True
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(36)]
    edges += [(100 + i, 100 + (i + 1) % 12) for i in range(12)] + [(50, 50), (111, 200), (201, 100), (None, 3), (7, None)] + edges[:5]
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == plain_components(edges)


def test_strong_components_of_names_and_of_none(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c")], "src string, dst string")
    assert sorted(map(tuple, graph.strong_components(edges).collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert graph.strong_components(edges.limit(0)).collect() == []


def test_snapshots_compare_from_the_roots(spark):
    old = {f"a/b/f{i}": f"{i}" for i in range(5)} | {f"same/s{i}/g": "g" for i in range(30)} | {"top": "1", "x/y/z": "1", "kind": "1", "gone/deep/er": "2"}
    new = {k: v for k, v in old.items() if k not in ("a/b/f2", "kind", "gone/deep/er")} | {"a/b/f3": "other", "a/new/n": "3", "kind/now/folder": "1", "top": "1"}
    frame = lambda held: spark.createDataFrame(list(held.items()), "file_path string, id string")
    (e1, r1), (e2, r2) = snapshots.snapshot(frame(old)), snapshots.snapshot(frame(new))
    fresh = snapshots.insert_trees(e1, e2)
    assert 0 < fresh.count() < e2.count() and fresh.where("name like 's%'").where("name <> 'same'").count() == 0
    entries = e1.unionByName(fresh)
    want = {(p, "added" if p not in old else "removed" if p not in new else "changed", old.get(p), new.get(p)) for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
    assert {tuple(r) for r in snapshots.compare(entries, r1, r2).collect()} == want
    changed = entries.where(F.col("tree_id") != entries.where("name = 's3'").first().tree_id)  # the unchanged folder is not opened
    assert {tuple(r) for r in snapshots.compare(changed, r1, r2).collect()} == want
    assert snapshots.compare(entries, r1, r1).count() == 0
    assert {r.path for r in snapshots.compare(entries, None, r2).collect()} == set(new)
    assert snapshots.snapshot(frame(old).limit(0))[1] is None


def test_commits_skip_an_unchanged_root(spark):
    none = spark.createDataFrame([], "id string, branch string, parent_id string, tree_id string, message string, number int")
    one = snapshots.commit(none, "t1", "first")
    assert snapshots.commit(one, "t1", "again").count() == 1
    rows = snapshots.commit(snapshots.commit(one, "t2", "second"), "t1", "back").orderBy("number").collect()
    assert [(r.tree_id, r.number, r.parent_id) for r in rows] == [("t1", 0, None), ("t2", 1, rows[0].id), ("t1", 2, rows[1].id)]


def tables(spark):
    files = [(i, "r", p, p.rsplit("/", 1)[1], s, None, AS_OF, AS_OF) for i, p, s in samples.FILES]
    edges = [(i, "r", a, b, "imports", ["aliasedBridgeExport"] if i == 1 else []) for i, a, b in samples.EDGES]
    return (
        spark.createDataFrame(files, "id int, repo string, file_path string, file_name string, summary string, symbol_spine string, last_seen_at timestamp_ntz, created_at timestamp_ntz"),
        spark.createDataFrame(edges, "id int, repo string, source_path string, target_path string, relation string, symbols array<string>"),
    )


@pytest.mark.parametrize("case", [samples.ROOM, samples.FULL, samples.COVERED])
def test_bridges_merge(spark, case):
    ranked, k, want = case
    files, edges = tables(spark)
    by_id = {r.id: r.asDict() for r in files.collect()}
    for e in (edges, edges.drop("symbols")):
        rows = graph.expand([by_id[i] | {"similarity": x} for i, x in ranked], "login rotation", files, e, k)
        assert sorted((r["id"], round(r["similarity"], 6), bool(r.get("bridge"))) for r in rows) == sorted(want)


def test_a_bridge_by_the_symbols_of_its_edge(spark):
    """The token stands in no file, only on the edge from the first row to its neighbour."""
    files, edges = tables(spark)
    seed = next(r.asDict() for r in files.collect() if r.id == 1) | {"similarity": 0.9}
    rows = graph.expand([seed], "session aliasedBridgeExport", files, edges, 5)
    assert [(r["id"], bool(r.get("bridge"))) for r in rows] == [(1, False), (2, True)]
    assert rows[1]["via"] == "src/auth.js" and rows[1]["similarity"] <= 0.84 * 0.9 + 1e-9
    assert [r["id"] for r in graph.expand([seed], "session aliasedBridgeExport", files, edges.drop("symbols"), 5)] == [1]
