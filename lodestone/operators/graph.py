"""Dependency graph: imports, dependents, gated bridges, walks, and the commit and tree hierarchies.

Import strings meet file paths by equi-joins on exploded candidate keys, never by a nested-loop LIKE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.operators.stages import stored
from lodestone.operators.versions import distinct_on


#: Seeds of a bridge; rows at the head of a full result that no bridge replaces are all but this many.
SEEDS, REPLACEABLE = 3, 2


def imports_of(edges: DataFrame, path: str) -> DataFrame:
    clean = path.lstrip("/")
    return distinct_on(edges.where(F.col("source_path").isin(clean, path)), ["target_path", "relation"], [F.desc("id")])


def dependents_of(edges: DataFrame, path: str) -> DataFrame:
    """Edges that point to a file; which spellings count depends on how telling its base name is."""
    clean = path.lstrip("/")
    folder, _, file = clean.rpartition("/")
    base = file.rsplit(".", 1)[0] if "." in file.lstrip(".") else file
    target, low = F.col("target_path"), F.lower("target_path")
    ends = lambda s: F.endswith(low, F.lit(s.lower()))
    near = target.isin(f"./{file}", f"./{base}")
    if base.lower() not in paths.GENERIC_BASENAMES:
        hit = (target == clean) | ends(clean) | F.contains(low, F.lit(base.lower()))
    elif folder:
        hit = (target == clean) | ends(clean) | ends(f"{folder}/{base}") | (F.startswith(F.col("source_path"), F.lit(f"{folder}/")) & near)
    else:
        hit = (target == clean) | ends(f"/{clean}") | near
    return distinct_on(edges.where(hit), ["source_path", "relation"], [F.desc("id")])


def symbols_of(symbols: DataFrame, path: str) -> DataFrame:
    found = symbols.where((F.col("file_path") == path.lstrip("/")) | (F.col("file_path") == path))
    return distinct_on(found, ["start_line", "symbol_name", "symbol_type"], [F.desc("id")]).orderBy("start_line", "symbol_name")


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (id, repo, source_path, target_path, ...) joined to the files (repo, file_path) that their targets name.

    Relative imports name a path, perhaps without its extension or as a folder with an index file; bare ones may also name
    any suffix of a path, unless they are generic. Both sides explode to a handful of keys.
    """
    target = F.col("target_path")
    relative = F.startswith(target, F.lit("./")) | F.startswith(target, F.lit("../"))

    def keyed(clean: Column) -> Column:
        def how(x: Column) -> Column:
            kind = F.when(x["climbs"], F.when(x["common"], "none").otherwise("tail")).when(relative | (x["common"] & ~F.contains(x["key"], F.lit("/"))), "whole").otherwise("any")
            return F.struct(x["key"].alias("key"), kind.alias("how"))

        key = F.regexp_replace(clean, r"^(\.\./)+", "")
        told = text.bound(key, lambda k: F.struct(k.alias("key"), F.startswith(clean, F.lit("../")).alias("climbs"), F.lower(paths.stem(k)).isin(*paths.GENERIC_BASENAMES).alias("common")))
        return text.bound(told, how)

    # exploded, not projected: a generator keeps Spark from writing the path's expression into every use of it
    asked = edges.where(~paths.is_external(target)).withColumn("__x", F.explode(F.array(text.bound(paths.resolved(F.col("source_path"), target), keyed))))
    asked = asked.withColumns({"__key": F.col("__x.key"), "__how": F.col("__x.how")}).drop("__x").where("__key <> '' and __how <> 'none'")
    path = F.col("file_path")
    script = paths.extname(path).isin(".js", ".ts", ".py")
    bare = F.left(path, F.length(path) - F.length(paths.extname(path)))
    tail = F.concat(paths.suffixes(path), F.when(script, paths.suffixes(bare)).otherwise(F.array().cast("array<string>")))
    both = F.struct(paths.whole_names(path).alias("full"), tail.alias("tail"))
    names = text.bound(both, lambda b: F.transform(F.array_distinct(F.concat(b["full"], b["tail"])), lambda n: F.struct(n.alias("name"), F.array_contains(b["full"], n).alias("full"), F.array_contains(b["tail"], n).alias("tail"))))
    keys = files.where(path.isNotNull()).select(F.col("repo").alias("__repo"), "file_path", F.explode(names).alias("__n")).select("__repo", "file_path", F.col("__n.name").alias("__name"), F.col("__n.full").alias("__full"), F.col("__n.tail").alias("__tail"))
    met = asked.join(keys, (F.col("repo") == F.col("__repo")) & (F.col("__key") == F.col("__name")))
    fits = (F.col("__how") == "any") | F.when(F.col("__how") == "whole", F.col("__full")).otherwise(F.col("__tail"))
    at = F.when(F.startswith(target, F.lit("@")), F.startswith(F.col("file_path"), F.lit("@"))).otherwise(True)
    return met.where(fits & at & (F.col("file_path") != F.col("source_path"))).drop("__key", "__how", "__repo", "__full", "__tail", "__name")


def first_seeds(hop1: DataFrame) -> DataFrame:
    """The first three distinct (repo, seed_path) of ranked rows (repo, file_path, rank), with their rank."""
    ranked = hop1.where("repo is not null and length(file_path) > 0").groupBy("repo", paths.strip_root(F.col("file_path")).alias("seed_path")).agg(F.min("rank").alias("rank"))
    return ranked.where("seed_path <> ''").orderBy("rank").limit(SEEDS)


def bridge_neighbours(edges: DataFrame, blobs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files one import away from the seeds (repo, seed_path), either way: latest blob of each (path, seed, edge), with the edge's symbols."""
    seeds = F.broadcast(seeds.select("repo", "seed_path").distinct().limit(SEEDS))
    files = blobs.where("file_path is not null").select("repo", "file_path").distinct()
    near = seeds.select("repo", F.col("seed_path").alias("file_path"))
    told = F.array_join("symbols", " ") if "symbols" in edges.columns else F.lit(None).cast("string")
    edges = edges.withColumn("edge_symbols", told)
    edges = edges.join(seeds.select("repo").distinct(), "repo", "left_semi")
    out = resolve(edges.join(seeds, (edges.repo == seeds.repo) & (edges.source_path == seeds.seed_path)).select(edges["*"], "seed_path"), files)
    into = resolve(edges, near).where("file_path <> source_path").withColumn("seed_path", F.col("file_path")).withColumn("file_path", F.col("source_path"))
    both = out.select("repo", "file_path", "seed_path", F.col("id").alias("edge_id"), "relation", "edge_symbols").unionByName(into.select("repo", "file_path", "seed_path", F.col("id").alias("edge_id"), "relation", "edge_symbols"))
    found = blobs.select("id", "repo", "file_path", "file_name", "summary", "symbol_spine", "last_seen_at", "created_at").join(both, ["repo", "file_path"])
    return distinct_on(found, ["repo", "file_path", "seed_path", "edge_id"], [F.coalesce("last_seen_at", "created_at").desc_nulls_last(), F.desc("id")])


#: The columns of a row in which the tokens of a query are looked for; and how many bridges are looked at, at least.
ROW_TEXTS, BRIDGE_ROWS = ("file_path", "file_name", "summary", "symbol_spine"), 250


def row_haystack() -> Column:
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ROW_TEXTS]))


def covered(tokens: list[str]) -> Column:
    """How many of the tokens a row's texts hold."""
    return text.count_covered(row_haystack(), tokens)


def covered_with_edge(tokens: list[str]) -> Column:
    """How many of the tokens a neighbour's texts hold, or the symbols of the edge that leads to it."""
    return text.count_covered(F.concat_ws("\n", row_haystack(), F.lower(F.col("edge_symbols"))), tokens)


def bridge_scores(neighbours: DataFrame, seed_scores: DataFrame, uncovered: list[str], top: Column | float) -> DataFrame:
    """Best row per neighbour: more uncovered tokens first, then the score min(seed * (0.72 + 0.12 * ratio), 0.84 * top, 0.84)."""
    top = F.lit(top) if isinstance(top, float) else top
    ratio = F.least(F.lit(1.0), F.col("n_uncovered") / F.lit(float(max(1, len(uncovered)))))
    scored = neighbours.join(F.broadcast(seed_scores.limit(100)), ["repo", "seed_path"]).withColumn("n_uncovered", covered_with_edge(uncovered)).where("n_uncovered > 0")
    scored = scored.withColumn("score", F.least(F.col("seed_score") * (0.72 + 0.12 * ratio), F.least(0.84 * top, F.lit(0.84))))
    return distinct_on(scored, ["repo", "file_path"], [F.desc("n_uncovered"), F.desc("score"), F.desc("id"), F.asc("seed_path"), F.desc("edge_id")])


def merge_bridges(hop1: list[dict], bridges: list[dict], k: int, cover) -> list[dict]:
    """At most k of the ranked rows and bridges, best similarity first. cover(row) tells how many tokens of the query a row holds.

    With room left, bridges fill it. A full list keeps its head; of the other rows the weakest (fewest tokens, then least
    similar, then last) gives way to a bridge that holds more tokens than it.
    """
    best = lambda rows: sorted(rows, key=lambda r: -(r["similarity"] or 0))[:k]
    if len(hop1) < k:
        return best([*hop1, *bridges[: k - len(hop1)]])
    kept = hop1[:k]
    if k <= 1:
        return kept
    open_ = set(range(max(1, k - REPLACEABLE), k))
    for b in bridges:
        if not open_:
            break
        weakest = min(open_, key=lambda i: (cover(kept[i]), kept[i]["similarity"] or 0, -i))
        if cover(kept[weakest]) < cover(b):
            kept[weakest] = b
            open_.discard(weakest)
    return best(kept)


def expand(hop1: list[dict], query: str, blobs: DataFrame, edges: DataFrame, k: int, repo: str | None = None) -> list[dict]:
    """Ranked rows (dicts with id, repo, file_path, file_name, summary, symbol_spine, similarity) with gated bridges merged in.

    Nothing is looked up unless some distinctive part of the query is in none of the rows. The rows and bridges that reach the
    driver are bounded by k and by ``BRIDGE_ROWS``.
    """
    spark = blobs.sparkSession
    _, tokens = text.query_identifiers(query or "", spark)
    if not hop1 or not tokens:
        return hop1
    held = text.py_covered(["\n".join(str(r.get(c) or "") for c in ROW_TEXTS).lower() for r in hop1], tokens)
    open_ = [t for i, t in enumerate(tokens) if not any(row[i] for row in held)]
    ranked = [(r["repo"], r["file_path"], i, r["similarity"]) for i, r in enumerate(hop1) if repo is None or r["repo"] == repo]
    if not open_ or not ranked:
        return hop1
    rows = spark.createDataFrame(ranked, "repo string, file_path string, rank int, seed_score double")
    seeds = first_seeds(rows)
    scores = rows.withColumn("seed_path", paths.strip_root(F.col("file_path"))).join(seeds.select("repo", "seed_path", "rank"), ["repo", "seed_path", "rank"]).select("repo", "seed_path", F.greatest("seed_score", F.lit(0.0)).alias("seed_score"))
    top = hop1[0]["similarity"]
    known = rows.select("repo", paths.strip_root(F.col("file_path")).alias("file_path")).where("file_path <> ''").distinct()
    near = bridge_neighbours(edges, blobs, seeds).join(F.broadcast(known), ["repo", "file_path"], "left_anti")
    near = near.where(~F.col("id").isin([r["id"] for r in hop1])) if hop1 else near
    found = bridge_scores(near, scores, open_, float(max(0.0, top)) if top is not None else 0.5).withColumn("n_covered", covered_with_edge(tokens))
    ordered = found.orderBy(F.desc("score"), F.desc("n_uncovered"), F.desc("n_covered"), "repo", "file_path").limit(max(BRIDGE_ROWS, 50 * k))
    bridges = [{"id": r.id, "repo": r.repo, "file_path": r.file_path, "file_name": r.file_name, "summary": r.summary or "", "symbol_spine": r.symbol_spine, "similarity": r.score, "bridge": True, "via": r.seed_path, "covered": r.n_covered} for r in ordered.collect()]
    n = {id(r): sum(row) for r, row in zip(hop1, held, strict=True)}
    return merge_bridges(hop1, bridges, k, lambda r: r["covered"] if r.get("bridge") else n[id(r)]) if bridges else hop1


def walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): the least number of steps from the start nodes along (src, dst), up to ``depth``.

    Each round is checkpointed, so that the plan does not grow with the depth, and drops the nodes seen before.
    """
    frontier = seen = stored(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = edges.join(frontier, edges.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = stored(seen.unionByName(frontier)) if d % 8 == 0 else seen.unionByName(frontier)
    return seen


def descend(tree: DataFrame, root: str, most: int = 1000) -> DataFrame:
    """All entries (object_id, path, depth) under a tree id, level by level; ``tree``: tree_id, name, object_id. ``most`` bounds the depth, as entries may form a cycle."""
    level = stored(tree.where(F.col("tree_id") == root).select("object_id", F.col("name").alias("path"), F.lit(1).alias("depth")))
    out = level
    for d in range(2, most + 1):
        up = level.select(F.col("object_id").alias("tree_id"), F.col("path").alias("above"))
        level = stored(tree.join(up, "tree_id").select("object_id", F.concat_ws("/", "above", "name").alias("path"), F.lit(d).alias("depth")))
        if level.isEmpty():
            return out
        out = stored(out.unionByName(level)) if d % 8 == 0 else out.unionByName(level)
    raise ValueError(f"deeper than {most}")


def ancestors(commits: DataFrame, heads: DataFrame, most: int = 100_000) -> DataFrame:
    """(head, id, generation): the commits on the parent chain of each head, itself first; ``commits``: id, parent_id.

    Chains double: after round i each commit knows the one 2^i parents up, so a chain of n takes log2(n) rounds.
    """
    jump = stored(commits.select("id", F.col("parent_id").alias("up")))
    found = stored(heads.select(F.col("id").alias("head"), "id", F.lit(0).alias("generation")))
    step = 1
    while step < most:
        hop = jump.select(F.col("id").alias("at"), "up").where("up is not null")
        more = found.join(hop, found.id == hop.at).select("head", F.col("up").alias("id"), (F.col("generation") + step).alias("generation"))
        more = stored(more)
        if more.isEmpty():
            return found
        found = stored(found.unionByName(more))
        far = jump.select(F.col("id").alias("up"), F.col("up").alias("far"))
        jump = stored(jump.join(far, "up", "left").select("id", F.col("far").alias("up")))
        step *= 2
    raise ValueError(f"more than {most} generations")


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of nodes that point to each other."""
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    ahead = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return ahead.where("a < b").join(back, ["a", "b"])


def strong_components(edges: DataFrame, trims: int = 2) -> DataFrame:
    """(node, component) for every node of (src, dst): component is the least node of those that reach each other.

    Nodes without an edge in or without one out are trimmed, as they are alone. Of the rest each takes the greatest node that
    reaches it; the nodes of such a colour that reach the node it is named by are one component. They leave, and the others go on.
    Colours and reach spread from the nodes that changed in the round before, and each round is checkpointed.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    rest = stored(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        for _ in range(trims):
            rest = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        rest = stored(rest)
        if rest.isEmpty():
            break
        colours = changed = stored(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("colour")))
        while not changed.isEmpty():
            offered = rest.join(changed.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
            both = stored(colours.join(offered, "node", "left").select("node", F.greatest("colour", "offer").alias("colour"), (F.col("offer") > F.col("colour")).alias("moved")))
            colours, changed = both.select("node", "colour"), both.where("moved").select("node", "colour")
        inside = rest.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst", "colour")
        inside = stored(inside)
        reached = frontier = stored(colours.where("node = colour"))
        while not frontier.isEmpty():
            step = inside.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = stored(step.join(reached.select("node"), "node", "left_anti"))
            reached = stored(reached.unionByName(frontier))
        named = stored(reached.join(reached.groupBy("colour").agg(F.min("node").alias("component")), "colour").select("node", "component"))
        found = named if found is None else stored(found.unionByName(named))
        gone = named.select("node")
        rest = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge points to."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def numbered_chain(df: DataFrame, partition: str, order: list[str], key: str) -> DataFrame:
    """Each row with the key before it as its parent and its number in the chain."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn("parent_id", F.lag(key).over(w)).withColumn("generation", F.row_number().over(w) - 1)
