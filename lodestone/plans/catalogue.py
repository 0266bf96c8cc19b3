"""The named queries of the engine and their DuckDB counterparts, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import hashing, paths, text, vector
from lodestone.operators import ann, answers, embedding, filters, graph, lexical, patterns, ranking, snapshots, substrings, upserts, versions
from lodestone.parse import frames
from lodestone.operators.stages import scratch
from lodestone.plans import views as v
from lodestone.sources import files, formats, paged
from lodestone.streaming import latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_TS = "coalesce(last_seen_at, created_at)"
_AGE = f"(epoch_us(TIMESTAMP '2024-02-01') - epoch_us({_TS})) / 86400000000.0"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- retrieval ---------------------------------------------------------------------------------------------------------

_HAY = "coalesce(file_name, '') || ' ' || coalesce(file_path, '') || ' ' || coalesce(symbol_spine, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, '')"
_SPLIT = r"regexp_replace(regexp_replace(hay, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"


def _hits(terms: list[str]) -> str:
    one = lambda t: " OR ".join(f"contains({h}, '{f}')" for f in dict.fromkeys([t, text.py_light_stem(t)]) for h in ("plain", "split"))
    return " + ".join(f"({one(t)})::INTEGER" for t in terms)


def _lexical(terms: list[str]) -> str:
    return f"""hay AS (SELECT *, {_HAY} AS hay FROM v_blob), low AS (SELECT *, lower(hay) AS plain, lower({_SPLIT}) AS split FROM hay),
      hit AS (SELECT *, {_hits(terms)} AS hits FROM low), lex AS (SELECT *, 0.25 + hits / {len(terms)}.0::DOUBLE * 0.75 AS raw FROM hit WHERE hits > 0)"""


_COSINE = "dense AS (SELECT *, list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS raw FROM v_blob WHERE embedding IS NOT NULL AND (embed_model IS NULL OR embed_model = 'active'))"


def _fresh(t: str) -> str:
    return f"""NOT EXISTS (SELECT 1 FROM v_blob n WHERE n.repo = {t}.repo AND n.file_path = {t}.file_path AND
      (coalesce(n.last_seen_at, n.created_at) > coalesce({t}.last_seen_at, {t}.created_at) OR (coalesce(n.last_seen_at, n.created_at) = coalesce({t}.last_seen_at, {t}.created_at) AND n.id > {t}.id)))"""


def _cut(src: str, out: str, first: int = 200, second: int = 100) -> str:
    return f"""{out}1 AS (SELECT * FROM {src} ORDER BY raw DESC, id LIMIT {first}), {out}2 AS (SELECT * FROM {out}1 t WHERE {_fresh('t')} ORDER BY raw DESC, id LIMIT {second}),
      {out} AS (SELECT id, raw, row_number() OVER (ORDER BY raw DESC, id) AS rk FROM {out}2)"""


_CALIBRATED = "CASE WHEN raw <= 0 THEN 0.0 WHEN raw >= 1 THEN 1.0 WHEN raw <= 0.12 THEN raw * 3.0 WHEN raw <= 0.38 THEN 0.36 + (raw - 0.12) / 0.26 * 0.32 WHEN raw <= 0.6 THEN 0.68 + (raw - 0.38) / 0.22 * 0.16 ELSE 0.84 + (raw - 0.6) / 0.4 * 0.16 END"
_TERMS = text.query_terms(v.QUERY_TEXT)


@query(f"""WITH {v.BLOBS}, {_COSINE}, {_lexical(_TERMS)}, {_cut('dense', 'd')}, {_cut('lex', 'x')},
  fused AS (SELECT coalesce(d.id, x.id) AS id, d.raw AS raw, x.raw AS lexical, coalesce(1.0::DOUBLE / (60.0::DOUBLE + d.rk), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + x.rk), 0) AS rrf FROM d FULL JOIN x ON d.id = x.id),
  final AS (SELECT b.*, f.raw, f.lexical, f.rrf * exp(-0.01 * {_AGE}) AS sim FROM fused f JOIN v_blob b ON b.id = f.id)
  SELECT id, repo, file_name, file_path, round(sim, 8) AS similarity, round(CASE WHEN raw IS NULL THEN 0.0 ELSE {_CALIBRATED} END, 6) AS dense_sim, round(coalesce(lexical, 0), 6) AS lexical_score
  FROM final ORDER BY sim DESC, id LIMIT 10""")
def hybrid_search_rrf(spark, sf):
    found = ranking.hybrid_search(v.blobs(spark, sf), v.QUERY_TEXT, v.query_vector(spark, sf), v.AS_OF, scorer="ratio")
    return found.select("id", "repo", "file_name", "file_path", F.round("similarity", 8).alias("similarity"), r6("dense_sim").alias("dense_sim"), r6("lexical_score").alias("lexical_score"))


@query(f"""WITH {v.BLOBS}, {_COSINE}, {_cut('dense', 'd')}
  SELECT b.id, b.repo, b.file_path, round(d.raw, 6) AS cosine, round(d.raw * exp(-0.01 * {_AGE}), 6) AS decayed FROM d JOIN v_blob b ON b.id = d.id ORDER BY d.raw * exp(-0.01 * {_AGE}) DESC, b.id LIMIT 10""")
def dense_search_decay(spark, sf):
    return ranking.dense_search(v.blobs(spark, sf), v.query_vector(spark, sf), v.AS_OF).select("id", "repo", "file_path", r6("cosine").alias("cosine"), r6("decayed").alias("decayed"))


@query(f"""WITH {v.BLOBS}, {_COSINE}, {_cut('dense', 'd')}
  SELECT b.id, round({_CALIBRATED.replace('raw', 'd.raw')} * exp(-0.01 * {_AGE}), 6) AS similarity FROM d JOIN v_blob b ON b.id = d.id ORDER BY d.raw * exp(-0.01 * {_AGE}) DESC, b.id LIMIT 10""")
def dense_search_calibrated(spark, sf):
    return ranking.dense_search(v.blobs(spark, sf), v.query_vector(spark, sf), v.AS_OF).select("id", r6("similarity").alias("similarity"))


def _keyword(q: str) -> str:
    return f"""WITH {v.BLOBS}, hay AS (SELECT *, {_HAY} AS hay FROM v_blob), low AS (SELECT *, lower(hay) AS plain, lower({_SPLIT}) AS split FROM hay),
      hit AS (SELECT *, {_hits(text.query_terms(q))} AS hits, contains(lower(file_name), '{q.lower()}') OR coalesce(contains(lower(file_path), '{q.lower()}'), false) AS named FROM low),
      scored AS (SELECT *, greatest(CASE WHEN hits > 0 THEN 0.25 + hits / {len(text.query_terms(q))}.0::DOUBLE * 0.75 ELSE 0.0 END, 0.1) * exp(-0.01 * {_AGE}) AS raw FROM hit WHERE hits > 0 OR named),
      top AS (SELECT * FROM scored ORDER BY raw DESC, id LIMIT 200)
      SELECT id, repo, file_path, round(raw, 6) AS similarity FROM top t WHERE {_fresh('t')} ORDER BY raw DESC, id LIMIT 10"""


@query(_keyword("pathetic clowns"))
def keyword_search(spark, sf):
    return ranking.keyword_search(v.blobs(spark, sf), "pathetic clowns", v.AS_OF, scorer="ratio").withColumn("similarity", r6("similarity"))


@query(_keyword("d3.txt"))
def keyword_fallback_ladder(spark, sf):
    """No vector: whatever the mode asked for, keywords answer."""
    return ranking.search(v.blobs(spark, sf), v.AS_OF, query_text="d3.txt", mode="hybrid", scorer="ratio").withColumn("similarity", r6("similarity"))


def _density_sql(name: str, hits: str, found: tuple[str, ...]) -> str:
    """Cover density of all words over (id, word, place, weight) as common table expressions, the last one named ``name``: ends by a
    self-join from every begin, runs that hold a shorter one left out."""
    listed = ", ".join(f"'{w}'" for w in found)
    return f"""{name}_h AS (SELECT * FROM {hits} WHERE word IN ({listed})),
      {name}_e AS (SELECT b.id, b.place AS p, n.word, min(n.place) AS q FROM {name}_h b JOIN {name}_h n ON n.id = b.id AND n.place >= b.place GROUP BY ALL),
      {name}_s AS (SELECT id, p, max(q) AS q FROM {name}_e GROUP BY id, p HAVING count(*) = {len(found)}),
      {name}_m AS (SELECT * FROM {name}_s s WHERE NOT EXISTS (SELECT 1 FROM {name}_s t WHERE t.id = s.id AND t.p > s.p AND t.q <= s.q)),
      {name}_c AS (SELECT m.id, count(*) / sum(1 / h.weight) / (1 + (m.q - m.p) - (count(*) - 1)) AS c FROM {name}_m m JOIN {name}_h h ON h.id = m.id AND h.place BETWEEN m.p AND m.q GROUP BY m.id, m.p, m.q),
      {name} AS (SELECT id, sum(c) AS density FROM {name}_c GROUP BY id)"""


_SYMBOL_PLACES = """sw AS (SELECT id, regexp_extract_all(lower(symbol_name || ' ' || signature || ' ' || content), '[a-z0-9]+') AS ws FROM v_symbol),
  places AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place, 0.1::DOUBLE AS weight FROM sw)"""


def _symbol_sql(q: str) -> str:
    return f"""WITH {v.SYMBOLS}, {_SYMBOL_PLACES}, {_density_sql('ranks', 'places', tuple(q.split()))},
      scored AS (SELECT s.*, CASE WHEN lower(symbol_name) = '{q}' THEN 1.0 WHEN contains(lower(symbol_name), '{q}') THEN 0.85 ELSE density END::DOUBLE AS sim FROM v_symbol s LEFT JOIN ranks r ON r.id = s.id),
      top AS (SELECT * FROM scored WHERE sim IS NOT NULL ORDER BY sim DESC, id DESC, start_line LIMIT 20),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY repo, file_path, symbol_name, symbol_type, start_line ORDER BY sim DESC, id DESC) AS n FROM top)
      SELECT id, symbol_name, symbol_type, file_path, round(sim, 6) AS similarity FROM firsts WHERE n = 1 ORDER BY sim DESC, id DESC LIMIT 10"""


def _symbols_found(spark, sf, q: str):
    return ranking.symbol_search(v.symbols(spark, sf), q).select("id", "symbol_name", "symbol_type", "file_path", r6("similarity").alias("similarity"))


@query(_symbol_sql("red"))
def symbol_search_ranked(spark, sf):
    return _symbols_found(spark, sf, "red")


@query(_symbol_sql("large red widget"))
def symbol_search_words(spark, sf):
    """Three words that must all be there, ranked by their density."""
    return _symbols_found(spark, sf, "large red widget")


@query(f"""WITH {v.SYMBOLS}, pick AS (SELECT symbol_name FROM v_symbol ORDER BY id LIMIT 1)
  SELECT id, symbol_name, file_path FROM v_symbol WHERE lower(symbol_name) = (SELECT lower(symbol_name) FROM pick) ORDER BY symbol_name = (SELECT symbol_name FROM pick) DESC, id DESC LIMIT 1""")
def symbol_lookup(spark, sf):
    s = v.symbols(spark, sf)
    return ranking.symbol_lookup(s, s.orderBy("id").first()["symbol_name"]).select("id", "symbol_name", "file_path")


# --- versions, duplicates, aggregates ----------------------------------------------------------------------------------

_LATEST = f"WITH {v.BLOBS} SELECT id, repo, file_path FROM v_blob t WHERE {_fresh('t')}"


@query(_LATEST)
def latest_version_window(spark, sf):
    return versions.latest_by_window(v.blobs(spark, sf)).select("id", "repo", "file_path")


@query(_LATEST)
def latest_version_antijoin(spark, sf):
    return versions.latest_by_antijoin(v.blobs(spark, sf)).select("id", "repo", "file_path")


@query(f"WITH {v.BLOBS} SELECT DISTINCT ON (repo, file_path) id, repo, file_path FROM v_blob WHERE file_path IS NOT NULL ORDER BY repo, file_path, last_seen_at DESC NULLS LAST, created_at DESC NULLS LAST, id DESC")
def distinct_on_latest(spark, sf):
    rows = v.blobs(spark, sf).where("file_path is not null")
    return versions.distinct_on(rows, ["repo", "file_path"], [F.col("last_seen_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.desc("id")]).select("id", "repo", "file_path")


@query(f"""WITH {v.BLOBS}, latest AS (SELECT DISTINCT ON (repo, file_path) * FROM v_blob WHERE file_path IS NOT NULL ORDER BY repo, file_path, coalesce(last_seen_at, created_at) DESC NULLS LAST, id DESC),
  pool AS (SELECT * FROM latest UNION ALL SELECT * FROM v_blob WHERE file_path IS NULL)
  SELECT id, repo, size FROM pool WHERE embedding IS NULL OR embed_model IS DISTINCT FROM 'active'""")
def backfill_candidates(spark, sf):
    return versions.latest_by_window(v.blobs(spark, sf)).where(F.col("embedding").isNull() | ~F.col("embed_model").eqNullSafe(F.lit("active"))).select("id", "repo", "size")


_DETAILS = "details AS (SELECT b.id * 10 AS id, b.repo, b.file_path, b.id AS blob_id FROM v_blob b WHERE b.file_path IS NOT NULL)"


@query(f"""WITH {v.BLOBS}, {_DETAILS}, latest AS (SELECT DISTINCT ON (repo, file_path) * FROM v_blob WHERE file_path IS NOT NULL ORDER BY repo, file_path, last_seen_at DESC NULLS LAST, created_at DESC NULLS LAST, id DESC)
  SELECT d.id, d.repo, d.blob_id FROM details d LEFT JOIN latest l ON d.repo = l.repo AND d.file_path = l.file_path WHERE l.id IS NULL OR d.blob_id = l.id""")
def purge_stale(spark, sf):
    b = v.blobs(spark, sf)
    details = b.where("file_path is not null").select((F.col("id") * 10).alias("id"), "repo", "file_path", F.col("id").alias("blob_id"))
    return versions.purge_stale(details, b).select("id", "repo", "blob_id")


@query(f"WITH {v.SYMBOLS} SELECT a.id, a.symbol_name FROM v_symbol a WHERE NOT EXISTS (SELECT 1 FROM v_symbol b WHERE a.id < b.id AND a.repo = b.repo AND a.symbol_name = b.symbol_name AND a.start_line = b.start_line AND a.symbol_hash = b.symbol_hash)")
def purge_exact_duplicates(spark, sf):
    return versions.drop_exact_duplicates(v.symbols(spark, sf), ["repo", "symbol_name", "start_line", "symbol_hash"]).select("id", "symbol_name")


@query(f"WITH {v.BLOBS}, repos AS (SELECT DISTINCT source AS repo FROM documents UNION ALL SELECT 'empty') SELECT r.repo, count(b.id) AS n_blobs, count(b.embedding) AS n_embedded FROM repos r LEFT JOIN v_blob b ON b.repo = r.repo GROUP BY r.repo")
def repo_embedding_summary(spark, sf):
    b = v.blobs(spark, sf)
    repos = b.select("repo").distinct().union(spark.sql("select 'empty'"))
    counts = b.groupBy("repo").agg(F.count("id").alias("n_blobs"), F.count("embedding").alias("n_embedded"))
    return repos.join(counts, "repo", "left").select("repo", F.coalesce("n_blobs", F.lit(0)).alias("n_blobs"), F.coalesce("n_embedded", F.lit(0)).alias("n_embedded"))


@query(f"WITH {v.BLOBS} SELECT storage_mode, count(*) AS n, sum(CASE WHEN content IS NOT NULL THEN strlen(content) ELSE 0 END)::BIGINT AS n_bytes, count(summary) AS n_summaries FROM v_blob GROUP BY storage_mode")
def storage_breakdown(spark, sf):
    return v.blobs(spark, sf).groupBy("storage_mode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).alias("n_bytes"), F.count("summary").alias("n_summaries"))


@query(f"WITH {v.SYMBOLS} SELECT repo, file_path, count(*) AS n, count(*) FILTER (WHERE symbol_hash IS NULL OR (symbol_type LIKE '%STEEL%' AND start_line = end_line)) AS n_stale FROM v_symbol GROUP BY repo, file_path")
def stale_symbol_counts(spark, sf):
    stale = F.col("symbol_hash").isNull() | (F.contains("symbol_type", F.lit("STEEL")) & (F.col("start_line") == F.col("end_line")))
    return v.symbols(spark, sf).groupBy("repo", "file_path").agg(F.count(F.lit(1)).alias("n"), F.count_if(stale).alias("n_stale"))


@query(f"WITH {v.SYMBOLS} SELECT repo, left(string_agg(DISTINCT symbol_name, ' ' ORDER BY symbol_name), 4000) AS spine FROM v_symbol GROUP BY repo")
def symbol_spine_agg(spark, sf):
    return v.symbols(spark, sf).groupBy("repo").agg(F.left(F.array_join(F.array_sort(F.collect_set("symbol_name")), " "), F.lit(text.MAX_SPINE)).alias("spine"))



@query("""WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, i, sum(x) AS x FROM e GROUP BY label, i),
  n AS (SELECT label, sqrt(sum(x * x)) AS size FROM s GROUP BY label) SELECT s.label, (s.i - 1)::INTEGER AS place, round(s.x / n.size, 6) AS x FROM s JOIN n ON s.label = n.label""")
def centroid(spark, sf):
    c = vector.centroid(v.table(spark, sf, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("place", "x")).withColumn("x", r6("x"))


# --- lookups and set operations ----------------------------------------------------------------------------------------


@query(f"WITH {v.BLOBS} SELECT id, repo, file_path FROM v_blob WHERE file_path = 'src/d1.txt' OR file_name = 'src/d1.txt' ORDER BY last_seen_at DESC NULLS FIRST, id DESC LIMIT 1")
def blob_by_path(spark, sf):
    b = v.blobs(spark, sf).where((F.col("file_path") == "src/d1.txt") | (F.col("file_name") == "src/d1.txt"))
    return b.orderBy(F.desc_nulls_first("last_seen_at"), F.desc("id")).limit(1).select("id", "repo", "file_path")


@query("SELECT source AS name, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY source")
def repo_listing(spark, sf):
    return v.table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT source FROM documents")
def project_union(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_brand").alias("name")).union(v.table(spark, sf, "documents").select("source")).distinct()


@query(f"WITH {v.HIERARCHY} SELECT t.tree_id, t.name, t.object_id FROM v_tree t WHERE t.tree_id IN (SELECT 'r' || r_regionkey::VARCHAR FROM region)")
def tree_entries_scoped(spark, sf):
    roots = v.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("tree_id"))
    return v.hierarchy(spark, sf).join(F.broadcast(roots), "tree_id", "left_semi").select("tree_id", "name", "object_id")


# --- graph -------------------------------------------------------------------------------------------------------------


@query(f"WITH {v.SYMBOLS} SELECT DISTINCT ON (start_line, symbol_name, symbol_type) id, symbol_name, start_line FROM v_symbol WHERE file_path = 'lib/brand11/7.js' ORDER BY start_line, symbol_name, symbol_type, id DESC")
def file_symbols(spark, sf):
    return graph.symbols_of(v.symbols(spark, sf), "/lib/brand11/7.js").select("id", "symbol_name", "start_line")


@query(f"WITH {v.BLOBS}, {v.IMPORTS} SELECT DISTINCT ON (target_path, relation) id, target_path, relation FROM v_import WHERE source_path = 'src/d2.txt' ORDER BY target_path, relation, id DESC")
def graph_imports(spark, sf):
    return graph.imports_of(v.imports(spark, sf), "src/d2.txt").select("id", "target_path", "relation")


@query(f"""WITH {v.BLOBS}, {v.IMPORTS} SELECT DISTINCT ON (source_path, relation) id, source_path, relation FROM v_import
  WHERE target_path = 'src/d2.txt' OR ends_with(lower(target_path), 'src/d2.txt') OR contains(lower(target_path), 'd2') ORDER BY source_path, relation, id DESC""")
def graph_dependents(spark, sf):
    return graph.dependents_of(v.imports(spark, sf), "src/d2.txt").select("id", "source_path", "relation")


_GENERIC_EDGES = "g AS (SELECT id, source_path, relation, CASE id % 4 WHEN 0 THEN './index.js' WHEN 1 THEN 'src/index.js' WHEN 2 THEN '../lib/index' ELSE './index' END AS target_path FROM v_import)"


@query(f"""WITH {v.BLOBS}, {v.IMPORTS}, {_GENERIC_EDGES} SELECT DISTINCT ON (source_path, relation) id, source_path, relation FROM g
  WHERE target_path = 'src/index.js' OR ends_with(lower(target_path), 'src/index.js') OR ends_with(lower(target_path), 'src/index') OR (starts_with(source_path, 'src/') AND target_path IN ('./index.js', './index')) ORDER BY source_path, relation, id DESC""")
def graph_dependents_generic(spark, sf):
    kind = F.col("id") % 4
    target = F.when(kind == 0, "./index.js").when(kind == 1, "src/index.js").when(kind == 2, "../lib/index").otherwise("./index")
    return graph.dependents_of(v.imports(spark, sf).withColumn("target_path", target), "src/index.js").select("id", "source_path", "relation")


_RESOLVED = f"""WITH {v.BLOBS}, {v.IMPORTS}, files AS (SELECT DISTINCT repo, file_path FROM v_blob WHERE file_path IS NOT NULL),
  keyed AS (SELECT *, CASE WHEN starts_with(target_path, './') THEN 'src/' || substr(target_path, 3) WHEN starts_with(target_path, '../../') THEN substr(target_path, 7) WHEN starts_with(target_path, '../') THEN substr(target_path, 4) ELSE target_path END AS k FROM v_import WHERE target_path <> 'node:fs'),
  resolved AS (SELECT e.*, f.file_path FROM keyed e JOIN files f ON e.repo = f.repo AND f.file_path <> e.source_path AND
    CASE WHEN starts_with(target_path, './') OR (starts_with(target_path, '../') AND NOT starts_with(target_path, '../../')) THEN f.file_path = k OR starts_with(f.file_path, k || '.')
         WHEN starts_with(target_path, '../../') THEN f.file_path = k OR ends_with(f.file_path, '/' || k) OR ends_with(f.file_path, '/' || k || '.js') OR ends_with(f.file_path, '/' || k || '.ts')
         ELSE f.file_path = k OR starts_with(f.file_path, k || '.') OR ends_with(f.file_path, '/' || k) END)"""


@query(f"{_RESOLVED} SELECT id, repo, source_path, target_path, file_path FROM resolved")
def resolved_imports(spark, sf):
    files = v.blobs(spark, sf).where("file_path is not null").select("repo", "file_path").distinct()
    return graph.resolve(v.imports(spark, sf), files).select("id", "repo", "source_path", "target_path", "file_path")


_SEEDS = [("src1", "src/d1.txt"), ("src2", "src/d2.txt"), ("src3", "src/d1.txt")]
_BRIDGE = f"""{_RESOLVED}, seeds(repo, seed_path, seed_score) AS (VALUES ('src1', 'src/d1.txt', 0.9::DOUBLE), ('src2', 'src/d2.txt', 0.8::DOUBLE), ('src3', 'src/d1.txt', 0.7::DOUBLE)),
  near AS (SELECT r.repo, r.file_path, s.seed_path, s.seed_score, r.id AS edge_id, r.symbols FROM resolved r JOIN seeds s ON r.repo = s.repo AND r.source_path = s.seed_path
    UNION ALL SELECT r.repo, r.source_path, s.seed_path, s.seed_score, r.id, r.symbols FROM resolved r JOIN seeds s ON r.repo = s.repo AND r.file_path = s.seed_path),
  latest AS (SELECT DISTINCT ON (n.repo, n.file_path, n.seed_path, n.edge_id) b.*, n.seed_path, n.seed_score, n.edge_id, n.symbols FROM near n JOIN v_blob b ON b.repo = n.repo AND b.file_path = n.file_path
    ORDER BY n.repo, n.file_path, n.seed_path, n.edge_id, coalesce(b.last_seen_at, b.created_at) DESC NULLS LAST, b.id DESC)"""


def _neighbours(spark, sf):
    seeds = spark.createDataFrame(_SEEDS, "repo string, seed_path string")
    return graph.bridge_neighbours(v.imports(spark, sf), v.blobs(spark, sf), seeds)


@query(f"{_BRIDGE} SELECT id, repo, file_path, seed_path, edge_id FROM latest")
def bridge_neighbors(spark, sf):
    return _neighbours(spark, sf).select("id", "repo", "file_path", "seed_path", "edge_id")


_TOKENS = ["the", "ciones", "txt"]


def _covered(tokens: list[str]) -> str:
    forms = {"ciones": ["ciones", "cione"]}
    return " + ".join("(" + " OR ".join(f"contains(h, '{f}') OR contains(hc, '{f}')" for f in forms.get(t, [t])) + ")::INTEGER" for t in tokens)


def _bridge_sql(tokens: list[str]) -> str:
    return f"""{_BRIDGE}, hay AS (SELECT *, lower(coalesce(file_path, '') || chr(10) || coalesce(file_name, '') || chr(10) || coalesce(summary, '') || chr(10) || coalesce(symbol_spine, '') || chr(10) || symbols) AS h FROM latest),
  hay2 AS (SELECT *, regexp_replace(h, '[_./-]+', '', 'g') AS hc FROM hay), cov AS (SELECT *, {_covered(tokens)} AS n_uncovered FROM hay2),
  scored AS (SELECT *, least(seed_score * (0.72 + 0.12 * least(1.0, n_uncovered / {len(tokens)}.0::DOUBLE)), least(0.84 * 0.9::DOUBLE, 0.84)) AS score FROM cov WHERE n_uncovered > 0)
  SELECT DISTINCT ON (repo, file_path) id, repo, file_path, n_uncovered, round(score, 6) AS score FROM scored ORDER BY repo, file_path, n_uncovered DESC, score DESC, id DESC, seed_path, edge_id DESC"""


def _bridges(spark, sf, tokens: list[str]):
    seeds = spark.createDataFrame([(*s, x) for s, x in zip(_SEEDS, (0.9, 0.8, 0.7), strict=True)], "repo string, seed_path string, seed_score double")
    return graph.bridge_scores(_neighbours(spark, sf), seeds, tokens, 0.9).select("id", "repo", "file_path", "n_uncovered", r6("score").alias("score"))


@query(_bridge_sql(_TOKENS))
def bridge_scores(spark, sf):
    return _bridges(spark, sf, _TOKENS)


@query(_bridge_sql(["aliasedbridge", "sym1"]))
def bridge_edge_symbols(spark, sf):
    """Tokens that stand on the symbols of an edge alone."""
    return _bridges(spark, sf, ["aliasedbridge", "sym1"])


def _cycle_edges(spark, sf):
    e = F.col("event_id")
    on = v.table(spark, sf, "events").select(e.alias("src"), F.when(e % 16 != 15, e + 1).alias("dst"))
    back = v.table(spark, sf, "events").where(e % 16 >= 9).where((e % 4 == 1) | (e % 32 > 16)).select(e.alias("src"), (e - e % 9).alias("dst"))
    return on.unionByName(back)


@query("""WITH RECURSIVE e AS (SELECT event_id AS src, event_id + 1 AS dst FROM events WHERE event_id % 16 <> 15 UNION ALL SELECT event_id, event_id - event_id % 9 FROM events WHERE event_id % 16 >= 9 AND (event_id % 4 = 1 OR event_id % 32 > 16)),
  n AS (SELECT DISTINCT unnest([src, dst]) AS node FROM (SELECT src, dst FROM e UNION ALL SELECT event_id, event_id FROM events)), reach AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b)
  SELECT r.a AS node, min(r.b) AS component FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY r.a""")
def strong_components(spark, sf):
    """Cycles of up to sixteen events, some of them through each other."""
    return graph.strong_components(_cycle_edges(spark, sf))


_OLD, _NEW = "NOT (b % 3 = 0 AND doc_id % 7 = 3)", "NOT (b % 3 = 0 AND doc_id % 11 = 5)"


def _snapshots(spark, sf):
    """Two snapshots of the documents; only files of every third folder differ."""
    i = F.col("doc_id")
    block = F.floor(i / 100)
    d = v.table(spark, sf, "documents").select(F.concat(F.lit("d"), block.cast("string"), F.lit("/e"), F.floor(i / 10).cast("string"), F.lit("/f"), i.cast("string")).alias("file_path"), "doc_id", block.alias("b"), "text")
    old = d.where(_OLD).select("file_path", F.md5(F.coalesce("text", F.lit(""))).alias("id"))
    new = d.where(_NEW).select("file_path", F.md5(F.concat(F.coalesce("text", F.lit("")), F.when((F.col("b") % 3 == 0) & (i % 13 == 0), "x").otherwise(""))).alias("id"))
    return snapshots.snapshot(old), snapshots.snapshot(new)


@query(f"""WITH d AS (SELECT doc_id, doc_id // 100 AS b, 'd' || (doc_id // 100)::VARCHAR || '/e' || (doc_id // 10)::VARCHAR || '/f' || doc_id::VARCHAR AS path, coalesce(text, '') AS text FROM documents),
  o AS (SELECT path, md5(text) AS old_id FROM d WHERE {_OLD}), n AS (SELECT path, md5(text || CASE WHEN b % 3 = 0 AND doc_id % 13 = 0 THEN 'x' ELSE '' END) AS new_id FROM d WHERE {_NEW})
  SELECT path, CASE WHEN old_id IS NULL THEN 'added' WHEN new_id IS NULL THEN 'removed' ELSE 'changed' END AS status, old_id, new_id FROM o FULL JOIN n USING (path) WHERE old_id IS DISTINCT FROM new_id""")
def snapshot_changes(spark, sf):
    """Two snapshots compared from their roots down, over trees that are stored once."""
    (old, a), (new, b) = _snapshots(spark, sf)
    return snapshots.compare(old.unionByName(snapshots.insert_trees(old, new)), a, b)


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def paged_conversations(spark, sf):
    """The conversations by pages of a hundred rows, a run of pages a partition."""
    shape = v.table(spark, sf, "conversations").schema.simpleString()
    rows = paged.read(spark, fetcher="lodestone.sources.paged:file_pages", path=f"{sf}/conversations.parquet")
    return rows.select(F.from_json("row", shape).alias("r")).select("r.conv_id", "r.turn", "r.role", F.md5("r.text").alias("digest"))


@query("SELECT user_id::VARCHAR AS key, epoch_us(max(ts)) AS latest_at, max_by(event_id, (ts, event_id)) AS id FROM events GROUP BY user_id")
def stream_latest_versions(spark, sf):
    """The last event of each user, by a stream with keyed state."""
    schema = v.table(spark, sf, "events").schema
    # as a pattern, since a stream takes a plain path for a folder
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    at = scratch(spark, "stream-latest")
    latest.start(latest.latest(rows), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return latest.current(spark, f"{at}/out").withColumnRenamed("at", "latest_at")


@query()
def ann_neighbours(spark, sf):
    """Ten neighbours from the index of every vector whose id is divisible by 20; approximate, so its recall is tested and not its rows."""
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = ann.build(spark, e, scratch(spark, "vector-index"))
    return index.search(e.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector"), 10, rerank=100)


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem), w AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3)
  SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node""")
def dependency_walk(spark, sf):
    return graph.walk(v.supply(spark, sf), spark.sql("select 1L as node"), 3)


@query("WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem) SELECT x.a, x.b FROM e x JOIN e y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def dependency_cycles(spark, sf):
    return graph.two_cycles(v.supply(spark, sf)).select("a", "b")


@query("SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def dead_targets(spark, sf):
    return graph.unreferenced(v.table(spark, sf, "part").select(F.col("p_partkey").alias("node")), v.supply(spark, sf))


@query("SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS fan_in FROM lineitem GROUP BY l_partkey")
def dependency_fan_in(spark, sf):
    return v.supply(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("fan_in"))


@query(f"""WITH RECURSIVE {v.HIERARCHY}, w AS (SELECT tree_id, name, object_id, type, name AS path, 1 AS depth FROM v_tree WHERE tree_id = 'root' UNION ALL SELECT t.tree_id, t.name, t.object_id, t.type, w.path || '/' || t.name, w.depth + 1 FROM w JOIN v_tree t ON t.tree_id = w.object_id)
  SELECT object_id, path, depth::INTEGER AS depth FROM w""")
def tree_walk(spark, sf):
    return graph.descend(v.hierarchy(spark, sf), "root")


@query("SELECT event_id, user_id, lag(event_id) OVER w AS parent_id, (row_number() OVER w - 1)::INTEGER AS generation FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def commit_ancestors(spark, sf):
    return graph.numbered_chain(v.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_id").select("event_id", "user_id", "parent_id", "generation")


# --- scalars -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha1(encode('blob ' || strlen(text)::VARCHAR || chr(0) || text)) AS blob_hash FROM documents")
def blob_hash(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", hashing.blob_hash(F.col("text")).alias("blob_hash"))


@query(r"SELECT page_id, sha256(regexp_replace(replace(html, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g')) AS symbol_hash FROM pages")
def symbol_hash(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", hashing.symbol_hash(F.col("html")).alias("symbol_hash"))


@query(f"""WITH {v.HIERARCHY}, b AS (SELECT tree_id, string_agg(type || ' ' || object_id || ' ' || name, chr(10) ORDER BY name, type, object_id) AS body FROM v_tree GROUP BY tree_id)
  SELECT tree_id, sha1(encode('tree ' || length(body)::VARCHAR || chr(0) || body)) AS tree_hash FROM b""")
def tree_hash(spark, sf):
    return v.hierarchy(spark, sf).groupBy("tree_id").agg(hashing.tree_hash(F.collect_list(F.struct("name", "type", "object_id"))).alias("tree_hash"))


@query("SELECT event_id, sha1(encode('commit ' || length('tree ' || md5(props) || chr(10) || 'message ' || event_type)::VARCHAR || chr(0) || 'tree ' || md5(props) || chr(10) || 'message ' || event_type)) AS commit_hash, left(md5(event_type || ':' || props), 12) AS row_id FROM events")
def commit_hash(spark, sf):
    return v.table(spark, sf, "events").select("event_id", hashing.commit_hash(F.md5("props"), F.col("event_type")).alias("commit_hash"), hashing.row_id(F.col("event_type"), F.col("props")).alias("row_id"))


_NAMES = "n AS (SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), '') || 'HTTPServer_v2.js' AS token FROM part)"
_SEGS = r"list_filter(regexp_split_to_array(token, '[^a-zA-Z0-9]+'), lambda s: length(s) >= 2)"
_CAMEL_SQL = r"regexp_replace(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"


def _token():
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))
    return F.concat(F.array_join(words, ""), F.lit("HTTPServer_v2.js"))


@query(rf"""WITH {_NAMES}, p AS (SELECT p_partkey, flatten(list_transform({_SEGS}, lambda s: CASE WHEN contains({_CAMEL_SQL}, ' ') THEN list_concat([s], string_split({_CAMEL_SQL}, ' ')) ELSE [s] END)) AS parts FROM n),
  u AS (SELECT p_partkey, lower(unnest(parts)) AS x, unnest(range(1, len(parts) + 1)) AS i FROM p), f AS (SELECT p_partkey, x, min(i) AS i FROM u WHERE length(x) >= 2 GROUP BY p_partkey, x)
  SELECT p_partkey, string_agg(x, ' ' ORDER BY i) AS subtokens FROM f GROUP BY p_partkey""")
def subtoken_split(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", F.array_join(text.subtokens(_token()), " ").alias("subtokens"))


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(rf"""WITH {_NAMES}, q AS (SELECT p_partkey, 'How to find the ' || token || ' in files' AS s FROM n), c AS (SELECT p_partkey, list_transform(regexp_split_to_array({_CAMEL_SQL}, '[^a-zA-Z0-9]+'), lambda x: lower(x)) AS parts FROM q),
  u AS (SELECT p_partkey, unnest(parts) AS x, unnest(range(1, len(parts) + 1)) AS i FROM c), f AS (SELECT p_partkey, x, min(i) AS i FROM u WHERE length(x) >= 2 AND NOT list_contains({_LIST(text.FILLERS)}, x) GROUP BY p_partkey, x),
  p AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM f WHERE NOT list_contains({_LIST(text.QUERY_STOPWORDS)}, x)) SELECT p_partkey, string_agg(x, ' OR ' ORDER BY i) AS expanded FROM p WHERE n <= 12 GROUP BY p_partkey""")
def expanded_query(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", text.expanded_query(F.concat(F.lit("How to find the "), _token(), F.lit(" in files"))).alias("expanded"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
  SELECT word, CASE WHEN length(word) < 4 THEN word WHEN ends_with(word, 'ies') AND length(word) >= 5 THEN left(word, length(word) - 3) || 'y' WHEN length(word) >= 5 AND regexp_matches(word, '(ches|shes|xes|zes|ses)$') THEN left(word, length(word) - 2)
    WHEN ends_with(word, 's') AND NOT regexp_matches(word, '(ss|us|is)$') THEN left(word, length(word) - 1) ELSE word END AS stem FROM w""")
def light_stem(spark, sf):
    words = v.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", text.light_stem(F.col("word")).alias("stem"))


@query(rf"""WITH t AS (SELECT page_id, regexp_extract_all(html, '[a-zA-Z_$][a-zA-Z0-9_$]{{2,}}') AS toks FROM pages), u AS (SELECT page_id, unnest(toks) AS x, unnest(range(1, len(toks) + 1)) AS i FROM t),
  f AS (SELECT page_id, x, min(i) AS i FROM u WHERE NOT list_contains({_LIST(text.KEYWORDS)}, x) GROUP BY page_id, x), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM f)
  SELECT page_id, 'page' || chr(10) || string_agg(x, ' ' ORDER BY i) AS tokens FROM r WHERE n <= 60 GROUP BY page_id""")
def compact_tokens(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", text.compact_tokens(F.col("html"), F.lit("page")).alias("tokens"))


_ASKED = ["licenseTerms", "MITLicense", "thand_ouer", "src/d1.txt", "General", "lib/none.js", "and/or", "e.g", "v1.2"]


@query(f"""WITH q(token) AS (VALUES {', '.join(f"('{t}')" for t in _ASKED[:4] + ['lib/none.js'])}), {v.BLOBS} SELECT token FROM q WHERE NOT EXISTS (SELECT 1 FROM v_blob WHERE contains(lower(coalesce(file_path, '') || chr(10) || coalesce(file_name, '') || chr(10) || coalesce(summary, '') || chr(10) || coalesce(symbol_spine, '')), lower(q.token)))""")
def unattested_identifiers(spark, sf):
    """Code-shaped words of a query that no row holds; a row is scanned once for all of them."""
    q = spark.createDataFrame([(t,) for t in _ASKED], "raw string").select(text.clean_candidate(F.col("raw")).alias("token"))
    asked = [r.token for r in q.where(text.code_shape(F.col("token")).isNotNull() & (text.code_shape(F.col("token")) != "kebab")).collect()]
    hay = graph.row_haystack()
    seen = v.blobs(spark, sf).select(*[F.contains(hay, F.lit(t.lower())).alias(f"t{i}") for i, t in enumerate(asked)]).agg(*[F.coalesce(F.bool_or(f"t{i}"), F.lit(False)).alias(f"t{i}") for i in range(len(asked))])
    told = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"t{i}").alias("seen")) for i, t in enumerate(asked)]))
    return seen.select(told.alias("x")).where("not x.seen").select("x.token")


@query("""WITH h AS (SELECT doc_id, text, '[' || source || ' :: d' || doc_id::VARCHAR || ']' || chr(10) AS head FROM documents), z AS (SELECT *, length(head) AS h, length(text) AS n, 1100 - length(head) AS body FROM h),
  c AS (SELECT *, CASE WHEN h + n <= 1100 THEN 1 ELSE greatest(1, ceil((n - body) / (body - 150.0)) + 1) END AS k FROM z), u AS (SELECT *, unnest(range(0, least(k, 50)::BIGINT)) AS i FROM c)
  SELECT doc_id, i::INTEGER AS chunk, md5(head || substr(text, i * (body - 150) + 1, CASE WHEN h + n <= 1100 THEN n ELSE body END)) AS digest FROM u""")
def chunk_windows(spark, sf):
    head = vector.chunk_header(F.col("source"), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return v.table(spark, sf, "documents").select("doc_id", F.posexplode(vector.chunks(F.col("text"), head)).alias("chunk", "body")).select("doc_id", "chunk", F.md5("body").alias("digest"))


@query(f"WITH {v.BLOBS} SELECT id, CASE WHEN file_path IS NULL THEN '' WHEN id % 7 = 0 THEN '[' || file_path || ']' || chr(10) ELSE '[' || repo || ' :: ' || file_path || ']' || chr(10) END AS header FROM v_blob")
def chunk_headers(spark, sf):
    return v.blobs(spark, sf).select("id", vector.chunk_header(F.when(F.col("id") % 7 != 0, F.col("repo")), F.col("file_path")).alias("header"))


@query("""WITH h AS (SELECT p_partkey, sha256(p_name) AS d FROM part), x AS (SELECT p_partkey, i, ('0x' || substr(d, (i % 16 * 4 + 1)::BIGINT, 4))::INTEGER / 65535.0::DOUBLE * 2 - 1 AS x FROM h, range(0, 32) r(i)), n AS (SELECT p_partkey, sqrt(sum(x * x)) AS size FROM x GROUP BY p_partkey)
  SELECT x.p_partkey, x.i::INTEGER AS place, round(x.x / n.size, 6) AS x FROM x JOIN n ON x.p_partkey = n.p_partkey""")
def deterministic_vector(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", F.posexplode(vector.deterministic(F.col("p_name"), 32)).alias("place", "x"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN 64 END AS dim FROM embeddings")
def vector_validate(spark, sf):
    e = v.table(spark, sf, "embeddings")
    broken = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 5 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    checked = vector.validated(broken, 64)
    return e.select("vec_id", F.when(checked.isNotNull(), F.size(checked)).alias("dim"))


@query("SELECT p_partkey, coalesce(nullif(lower(replace(p_brand, 'Brand#', 'B-')), ''), 'x') AS model FROM part")
def model_canonical(spark, sf):
    dressed = F.concat(F.lit(" Models/OLLAMA/"), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("B-")), F.lit(":latest "))
    return v.table(spark, sf, "part").select("p_partkey", vector.canonical_model(dressed).alias("model"))


@query(r"SELECT doc_id, length(text) < 20 OR starts_with(text, 'data:image') OR starts_with(text, 'iVBOR') OR starts_with(text, '/9j/') OR (len(string_split(text, chr(10))) < 3 AND length(text) > 5000) AS is_binary, regexp_matches(left(text, 200), '[\x00-\x08\x0e-\x1f]') AS has_control FROM documents")
def likely_binary(spark, sf):
    t = F.col("text")
    return v.table(spark, sf, "documents").select("doc_id", filters.looks_binary(t).alias("is_binary"), filters.has_control(t).alias("has_control"))


_NAMED = "f AS (SELECT doc_id, n_chars, 'a' || doc_id::VARCHAR || list_extract(['.JS', '.py', '.bin', '.md', '', '.tar.gz'], (doc_id % 6 + 1)::INTEGER) AS name FROM documents)"


@query(f"WITH {_NAMED} SELECT doc_id, doc_id % 6 IN (0, 1, 3) AS embeddable, CASE WHEN doc_id % 6 IN (0, 1, 3) THEN n_chars * 40 <= 512000 ELSE n_chars * 40 <= 102400 END AS fits FROM f")
def embeddable_filter(spark, sf):
    name = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".JS", ".py", ".bin", ".md", "", ".tar.gz"))), (F.col("doc_id") % 6 + 1).cast("int")))
    return v.table(spark, sf, "documents").select("doc_id", filters.is_embeddable(name).alias("embeddable"), filters.within_size(name, F.col("n_chars") * 40).alias("fits"))


@query(f"WITH {v.BLOBS} SELECT id, size FROM v_blob WHERE (summary IS NULL OR length(summary) >= 450 OR summary NOT LIKE '%[%]%') AND size > 30 AND size < 50000")
def tag_candidates(spark, sf):
    return v.blobs(spark, sf).where(filters.wants_tags(F.col("summary"), F.col("size"))).select("id", "size")


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN contains(url, '.html') THEN '.html' ELSE '' END AS ext FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') AS url FROM pages) p")
def path_parts(spark, sf):
    p = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/$", "")
    return v.table(spark, sf, "pages").select("page_id", paths.basename(p).alias("name"), paths.extname(p).alias("ext"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/c' WHEN 1 THEN '../d' ELSE 'a/b/e.js' END AS norm FROM part")
def path_normalise(spark, sf):
    k = F.col("p_partkey") % 3
    return v.table(spark, sf, "part").select("p_partkey", paths.normalise(F.when(k == 0, "./a/b/../c").when(k == 1, "x/../../d").otherwise("a//b/./e.js")).alias("norm"))


_SHAPES = {"camel": "foldName", "pascal": "FoldName", "snake": "fold_name", "kebab": "fold-name", "dotted": "fold.name", "path": "lib/fold/name"}


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'camel' WHEN 1 THEN 'pascal' WHEN 2 THEN 'snake' WHEN 3 THEN 'kebab' WHEN 4 THEN 'dotted' WHEN 5 THEN 'path' END AS shape FROM part")
def code_shapes(spark, sf):
    token = F.element_at(F.array(*[F.lit(x) for x in (*_SHAPES.values(), "and/or", "fold")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return v.table(spark, sf, "part").select("p_partkey", text.code_shape(token).alias("shape"))


# --- formats and pages -------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY conv_id)
  SELECT conv_id, left(full_text, 8000) AS text, 'agent_' || left(md5(left(full_text, 500)), 12) AS id FROM t""")
def conversation_trajectory(spark, sf):
    return formats.trajectories(v.table(spark, sf, "conversations")).select("conv_id", "text", "id")


@query("""SELECT 'p_name: ' || p_name || chr(10) || chr(10) || 'p_brand: ' || p_brand || chr(10) || chr(10) || 'p_type: ' || p_type AS text, left(md5(left(CASE WHEN length(p_name) > 5 THEN p_name ELSE p_brand END, 200)), 12) AS id FROM part""")
def generic_row_format(spark, sf):
    return formats.any_rows(v.table(spark, sf, "part"), ["p_name", "p_brand", "p_type"]).select("text", "id")


@query(f"WITH {v.LINKS} SELECT id, source_path, target_path FROM v_link")
def page_link_edges(spark, sf):
    return v.links(spark, sf).select("id", "source_path", "target_path")


@query("SELECT page_id, (n - 1)::INTEGER AS pos, heads[n] AS title FROM (SELECT page_id, regexp_extract_all(html, '<h[1-4][^>]*>([^<]*)</h', 1) AS heads FROM pages) p, LATERAL (SELECT unnest(range(1, len(heads) + 1)) AS n) u")
def page_sections(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-4][^>]*>([^<]*)</h"), F.lit(1))).alias("pos", "title"))


# --- writes ------------------------------------------------------------------------------------------------------------

_COLS = ["id", "repo", "file_path", "summary"]


@query(f"""WITH {v.BLOBS}, old AS (SELECT id, repo, file_path, summary FROM v_blob WHERE id % 3 <> 0), new AS (SELECT id, repo || '-x' AS repo, file_path, CASE WHEN id % 2 = 0 THEN 'new' END AS summary FROM v_blob WHERE id % 3 <> 1)
  SELECT coalesce(n.id, o.id) AS id, coalesce(n.repo, o.repo) AS repo, CASE WHEN n.id IS NULL THEN o.file_path ELSE n.file_path END AS file_path, coalesce(n.summary, o.summary) AS summary FROM old o FULL JOIN new n ON o.id = n.id""")
def upsert_blobs(spark, sf):
    b = v.blobs(spark, sf).select(*_COLS)
    new = b.where("id % 3 <> 1").select("id", F.concat("repo", F.lit("-x")).alias("repo"), "file_path", F.when(F.col("id") % 2 == 0, "new").alias("summary"))
    return upserts.upsert(b.where("id % 3 <> 0"), new)


@query(f"WITH {v.BLOBS} SELECT id, repo FROM v_blob WHERE id % 3 <> 0 UNION ALL SELECT id, repo || '-x' FROM v_blob WHERE id % 3 = 0")
def insert_absent(spark, sf):
    b = v.blobs(spark, sf).select("id", "repo")
    return upserts.insert_absent(b.where("id % 3 <> 0"), b.select("id", F.concat("repo", F.lit("-x")).alias("repo")))


@query(f"WITH {v.BLOBS} SELECT id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2024-02-01' ELSE last_seen_at END AS last_seen_at, CASE WHEN id % 4 = 0 THEN coalesce(file_path, 'found') ELSE file_path END AS file_path FROM v_blob")
def touch_last_seen(spark, sf):
    b = v.blobs(spark, sf).select("id", "file_name", "file_path", "last_seen_at")
    seen = b.where("id % 4 = 0").select("id", "file_name", F.lit("found").alias("file_path"))
    return upserts.touch(b, seen, v.AS_OF).select("id", "last_seen_at", "file_path")


@query(f"WITH {v.BLOBS} SELECT id, embedding IS NULL AS missing, embedding IS NULL OR embed_model IS DISTINCT FROM 'active' AS stale FROM v_blob WHERE regexp_matches(content, '[^ \\t\\n\\r\\f\\v]')")
def reembed_decision(spark, sf):
    b = v.blobs(spark, sf).where(F.rlike("content", F.lit(r"\S")))
    return b.select("id", upserts.needs_embedding("active").alias("missing"), upserts.needs_embedding("active", True).alias("stale"))


@query(f"WITH {v.SYMBOLS}, s AS (SELECT id, repo, blob_id, file_path FROM v_symbol) SELECT id, repo FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.id % 50 = 0 AND a.repo = b.repo AND (a.blob_id = b.blob_id OR a.file_path = b.file_path)) UNION ALL SELECT -id, repo FROM s WHERE id % 50 = 0")
def replace_scope(spark, sf):
    s = v.symbols(spark, sf).select("id", "repo", "blob_id", "file_path")
    scope = s.where("id % 50 = 0")
    return upserts.replace_scope(s, scope.withColumn("id", -F.col("id")), scope).select("id", "repo")


@query(f"WITH {v.BLOBS} SELECT id, CASE WHEN repo NOT LIKE 'src1%' AND storage_mode <> 'pointer' THEN 'pointer' ELSE storage_mode END AS storage_mode, CASE WHEN repo NOT LIKE 'src1%' AND storage_mode <> 'pointer' THEN coalesce(summary, left(content, 500)) ELSE summary END AS summary FROM v_blob")
def pointer_migration(spark, sf):
    return upserts.to_pointers(v.blobs(spark, sf), ("src1%",)).select("id", "storage_mode", "summary")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, sf):
    gone = v.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return upserts.cascade(v.table(spark, sf, "orders"), gone, "o_custkey").select("o_orderkey")


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last_id FROM events GROUP BY user_id, event_type")
def ingest_counters(spark, sf):
    return v.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last_id"))


@query("SELECT event_id, CASE WHEN props LIKE '{%' THEN (props::JSON ->> 'k')::BIGINT END AS k FROM events")
def json_decode(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 3")
def top_per_group(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return v.table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


# --- sources and the rest of the inventory -----------------------------------------------------------------------------


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS snippet FROM documents")
def snippet_lines(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", files.snippet(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"))


@query("SELECT doc_id, length(CASE WHEN length(text) * 40 > 500000 THEN left(repeat(text, 40), 500000) || chr(10) || '... (truncated)' ELSE repeat(text, 40) END)::INTEGER AS n FROM documents")
def shown_content(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.length(files.shown(F.repeat("text", F.lit(40)))).alias("n"))


@query("SELECT event_id, sha1(encode(event_id::VARCHAR)) AS id, CASE WHEN event_id % 3 <> 0 THEN sha1(encode((event_id - 1)::VARCHAR)) END AS parent_id, event_type AS author, 'a|b ' || props AS message FROM events")
def git_log_lines(spark, sf):
    e = v.table(spark, sf, "events")
    sha = lambda c: F.sha1(c.cast("string"))
    parents = F.when(F.col("event_id") % 3 != 0, F.concat_ws(" ", sha(F.col("event_id") - 1), sha(F.col("event_id") - 2))).otherwise("")
    lines = e.select("event_id", F.concat_ws("|", sha(F.col("event_id")), parents, "event_type", F.concat(F.lit("a|b "), "props")).alias("value"))
    parsed = files.git_log(lines.select("value"))
    return parsed.join(e.select("event_id", sha(F.col("event_id")).alias("id")), "id").select("event_id", "id", "parent_id", "author", "message")


@query("SELECT page_id, NOT (contains(url, '/en/')) AS walked FROM pages")
def walk_filter(spark, sf):
    p = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/en/", "/node_modules/")
    return v.table(spark, sf, "pages").select("page_id", filters.is_walked(p).alias("walked"))


@query(f"""WITH {v.BLOBS}, {v.IMPORTS} SELECT id, repo || '::' || CASE id % 5 WHEN 0 THEN 'src/d' || (id // 60 + id % 3)::VARCHAR WHEN 1 THEN 'src/d' || (id // 60 + id % 3)::VARCHAR || '.txt'
  WHEN 3 THEN 'src/d' || (id // 60 + id % 3)::VARCHAR || '.txt' WHEN 2 THEN 'pkg:d' || (id // 60 + id % 3)::VARCHAR || '.txt' ELSE 'pkg:node:fs' END AS target_id FROM v_import""")
def import_doc_ids(spark, sf):
    return v.imports(spark, sf).select("id", paths.document_id(F.col("repo"), F.col("source_path"), F.col("target_path")).alias("target_id"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS raw FROM embeddings, q),
  t AS (SELECT * FROM s ORDER BY raw DESC, vec_id LIMIT 40), c AS (SELECT *, """ + _CALIBRATED + """ AS calibrated FROM t) SELECT vec_id, round(raw, 6) AS raw FROM c WHERE raw >= 0.35 OR calibrated >= 0.55""")
def semantic_symbol_floor(spark, sf):
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("string").alias("embed_model"))
    return ranking.semantic_symbols(e, v.query_vector(spark, sf), 40).select(F.col("id").alias("vec_id"), r6("raw").alias("raw"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name || ' [' || p_brand || ', ' || p_type || ']' END AS summary FROM part")
def tagged_answers(spark, sf):
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("p_name").alias("summary"), F.array("p_brand", "p_type").alias("tags"))), F.lit("\n``` done"))
    return v.table(spark, sf, "part").select("p_partkey", formats.tagged_summary(F.when(F.col("p_partkey") % 4 != 0, body).otherwise("no answer")).alias("summary"))


@query("""SELECT 'lc_' || p_partkey::VARCHAR AS id, left('# ' || p_partkey::VARCHAR || ' [' || p_brand || ']' || chr(10) || 'Tags: ' || p_type || ', x' || chr(10) || chr(10) || 'Problem:' || chr(10) || p_name || chr(10) || chr(10) || 'Solution:' || chr(10) || p_type
  || chr(10) || chr(10) || 'Explanation:' || chr(10), 8000) AS text FROM part""")
def exercise_format(spark, sf):
    rows = v.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("task_id"), F.col("p_brand").alias("difficulty"), F.array("p_type", F.lit("x")).alias("tags"), F.col("p_name").alias("problem_description"), F.col("p_type").alias("completion"), F.lit(None).cast("string").alias("response"))
    return formats.exercises(rows).select("id", "text")


@query("""SELECT 'Commit Message:' || chr(10) || event_type || chr(10) || chr(10) || 'File: f' || user_id::VARCHAR || chr(10) || chr(10) || 'Before:' || chr(10) || '(new file)' || chr(10) || chr(10) || 'After:' || chr(10) || props AS text FROM events""")
def commit_pack_format(spark, sf):
    none = F.lit(None).cast("string")
    rows = v.table(spark, sf, "events").select(F.col("event_type").alias("subject"), none.alias("message"), none.alias("old_contents"), F.col("props").alias("new_contents"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("old_file"), none.alias("new_file"))
    return formats.commit_packs(rows).select("text")


@query(f"""WITH {v.BLOBS} SELECT b.id, b.repo, r.n FROM v_blob b JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) r ON r.source = b.repo WHERE b.id = 5""")
def blob_by_id(spark, sf):
    repos = v.table(spark, sf, "documents").groupBy(F.col("source").alias("repo")).agg(F.count(F.lit(1)).alias("n"))
    return v.blobs(spark, sf).where("id = 5").select("id", "repo").join(repos, "repo").select("id", "repo", "n")


@query("""WITH b AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS head FROM events GROUP BY user_id) SELECT b.user_id, e.event_id AS commit_id, md5(e.props) AS tree_id FROM b JOIN events e ON e.event_id = b.head""")
def root_trees(spark, sf):
    """Heads of branches (the last event of each user) and their trees."""
    e = v.table(spark, sf, "events")
    heads = e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("head"))
    return heads.join(e.select("event_id", "props"), F.col("head") == F.col("event_id")).select("user_id", F.col("event_id").alias("commit_id"), F.md5("props").alias("tree_id"))


# --- the weighted index ------------------------------------------------------------------------------------------------

#: Words of the documents by their English stem: all that the tables hold.
_FORMS = {
    "idiot": "idiot idiots", "clown": "clown clowns", "ther": "ther therly thers therlying therlyed",
    "tion": "tion tionly tione tiones tioned tioning tionedly tioningly tionlying tionlyed",
}
_STEMMED = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(w) for w in forms.split())}) THEN '{stem}'" for stem, forms in _FORMS.items()) + " END"
_PLACES = rf"""told AS (SELECT id, coalesce(file_name, '') || ' ' || coalesce(file_path, '') AS names, coalesce(symbol_spine, '') AS spine, coalesce(summary, '') AS summary FROM v_blob),
  cut AS (SELECT id, regexp_extract_all(lower(names), '[a-z0-9]+') AS a, regexp_extract_all(lower(translate(regexp_replace(names || ' ' || spine, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_/.-', '    ')), '[a-z0-9]+') AS b,
    regexp_extract_all(lower(spine), '[a-z0-9]+') AS c, regexp_extract_all(lower(summary), '[a-z0-9]+') AS d FROM told),
  rows AS (SELECT id, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS place, 1.0::DOUBLE AS weight, false AS english FROM cut UNION ALL SELECT id, unnest(b), len(a) + unnest(range(1, len(b) + 1)), 1.0, true FROM cut
    UNION ALL SELECT id, unnest(c), len(a) + len(b) + unnest(range(1, len(c) + 1)), 0.4, false FROM cut UNION ALL SELECT id, unnest(d), len(a) + len(b) + len(c) + unnest(range(1, len(d) + 1)), 0.2, true FROM cut),
  places AS (SELECT id, CASE WHEN english THEN {_STEMMED} ELSE w END AS word, place, weight FROM rows)"""


def _cover(plain: str, stems: str, name: str = "lex") -> str:
    """Scores of the weighted index as common table expressions, the last one (id, raw); the stems are those of the any-word part too."""
    listed = ", ".join(f"'{w}'" for w in stems.split())
    return f"""{_PLACES}, {_density_sql('exact', 'places', tuple(plain.split()))}, {_density_sql('stemmed', 'places', tuple(stems.split()))}, loose AS (SELECT id, sum(weight) AS density FROM places WHERE word IN ({listed}) GROUP BY id),
  {name} AS (SELECT l.id, 1.5 * coalesce(e.density, 0) + 1.25 * coalesce(s.density, 0) + l.density AS raw FROM loose l LEFT JOIN exact e ON e.id = l.id LEFT JOIN stemmed s ON s.id = l.id)"""


def _index(spark, sf):
    """The stored index of the blobs."""
    b = v.blobs(spark, sf)
    return lexical.build(spark, lexical.places(b), scratch(spark, "text-index"), b.count())


def _keyword_cover(plain: str, stems: str) -> str:
    return f"""WITH {v.BLOBS}, {_cover(plain, stems)}, scored AS (SELECT b.*, greatest(raw, 0.1) * exp(-0.01 * {_AGE}) AS raw FROM v_blob b JOIN lex ON lex.id = b.id), top AS (SELECT * FROM scored ORDER BY raw DESC, id LIMIT 200)
  SELECT id, repo, file_path, round(raw, 6) AS similarity FROM top t WHERE {_fresh('t')} ORDER BY raw DESC, id LIMIT 10"""


@query(_keyword_cover("idiot", "idiot"))
def keyword_search_cover(spark, sf):
    """Keyword search by the cover density of the weighted index, made in flight."""
    return ranking.keyword_search(v.blobs(spark, sf), "idiot", v.AS_OF).withColumn("similarity", r6("similarity"))


@query(_keyword_cover("ther tions", "ther tion"))
def keyword_search_words(spark, sf):
    """Several words, one in another form, over the stored index."""
    return ranking.keyword_search(v.blobs(spark, sf), "Ther TIONS", v.AS_OF, index=_index(spark, sf)).withColumn("similarity", r6("similarity"))


def _hybrid_cover(plain: str, stems: str) -> str:
    return f"""WITH {v.BLOBS}, {_COSINE}, {_cover(plain, stems, 'scores')}, lex AS (SELECT b.*, raw FROM v_blob b JOIN scores ON scores.id = b.id), {_cut('dense', 'd')}, {_cut('lex', 'x')},
  fused AS (SELECT coalesce(d.id, x.id) AS id, x.raw AS lexical, coalesce(1.0::DOUBLE / (60.0::DOUBLE + d.rk), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + x.rk), 0) AS rrf FROM d FULL JOIN x ON d.id = x.id),
  final AS (SELECT b.*, f.lexical, f.rrf * exp(-0.01 * {_AGE}) AS sim FROM fused f JOIN v_blob b ON b.id = f.id)
  SELECT id, repo, round(sim, 8) AS similarity, round(coalesce(lexical, 0), 6) AS lexical_score FROM final ORDER BY sim DESC, id LIMIT 10"""


def _hybrid(spark, sf, q: str, index=None):
    found = ranking.hybrid_search(v.blobs(spark, sf), q, v.query_vector(spark, sf), v.AS_OF, index=index)
    return found.select("id", "repo", F.round("similarity", 8).alias("similarity"), r6("lexical_score").alias("lexical_score"))


@query(_hybrid_cover("idiot", "idiot"))
def hybrid_search_cover(spark, sf):
    """The weighted index made in flight."""
    return _hybrid(spark, sf, "idiot")


@query(_hybrid_cover("clown idiot of the tion", "clown idiot tion"))
def hybrid_search_words(spark, sf):
    """Stop words and several words, over the stored index with its block bounds."""
    return _hybrid(spark, sf, "the clown of the idiot tion", _index(spark, sf))


@query(f"""WITH {v.BLOBS}, {_cover('clown ther tion', 'clown ther tion')} SELECT id, round(raw, 6) AS score FROM lex ORDER BY raw DESC, id LIMIT 20""")
def text_index_top(spark, sf):
    """The best rows of the stored index alone."""
    return _index(spark, sf).top("tion clown ther", 20).select("id", r6("score").alias("score"))


@query(f"""WITH {v.SYMBOLS}, w AS (SELECT id, regexp_extract_all(lower(symbol_name || ' ' || signature || ' ' || content), '[a-z0-9]+') AS ws FROM v_symbol) SELECT id, unnest(range(1, len(ws) + 1))::INTEGER AS place, unnest(ws) AS word, 0.1::DOUBLE AS weight FROM w""")
def symbol_index(spark, sf):
    """Places of the words in the text index of symbols."""
    return lexical.index_of_symbols(v.symbols(spark, sf)).select("id", "place", "word", "weight")


# --- tools ---------------------------------------------------------------------------------------------------------------


def _engine(spark, sf):
    b = v.blobs(spark, sf)
    repos = v.table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("id")).withColumn("created_at", F.lit(v.AS_OF))
    return Engine(repos, b, v.symbols(spark, sf), v.imports(spark, sf), v.hierarchy(spark, sf))


@query("SELECT source AS name, min(doc_id) AS id FROM documents GROUP BY source")
def tool_list_repos(spark, sf):
    return _engine(spark, sf).list_repos().select("name", "id")


@query(f"WITH {v.HIERARCHY} SELECT name, object_id, type FROM v_tree WHERE tree_id = 'root'")
def tool_read_tree(spark, sf):
    return _engine(spark, sf).read_tree("root").select("name", "object_id", "type")


@query(f"WITH {v.BLOBS} SELECT id, md5(content) AS digest FROM v_blob WHERE file_path = 'src/d1.txt' OR file_name = 'src/d1.txt' ORDER BY last_seen_at DESC NULLS FIRST, id DESC LIMIT 1")
def tool_read_blob(spark, sf):
    return _engine(spark, sf).read_blob("/src/d1.txt").select("id", F.md5("content").alias("digest"))


@query(f"""WITH {v.BLOBS}, {v.IMPORTS}, {v.SYMBOLS}, up AS (SELECT DISTINCT ON (target_path, relation) id FROM v_import WHERE source_path = 'src/d2.txt' ORDER BY target_path, relation, id DESC),
  down AS (SELECT DISTINCT ON (source_path, relation) id FROM v_import WHERE target_path = 'src/d2.txt' OR ends_with(lower(target_path), 'src/d2.txt') OR contains(lower(target_path), 'd2') ORDER BY source_path, relation, id DESC)
  SELECT 'imports' AS part, id FROM up UNION ALL SELECT 'dependents', id FROM down""")
def tool_dependency_graph(spark, sf):
    parts = _engine(spark, sf).dependency_graph("src/d2.txt")
    return parts["imports"].select(F.lit("imports").alias("part"), "id").unionByName(parts["dependents"].select(F.lit("dependents").alias("part"), "id")).unionByName(parts["symbols"].select(F.lit("symbols").alias("part"), "id"))


@query("SELECT p_partkey, 'query: ' || p_name AS input FROM part")
def query_inputs(spark, sf):
    once = vector.query_input(F.col("p_name"))
    return v.table(spark, sf, "part").select("p_partkey", vector.query_input(once).alias("input"))


@query("""WITH RECURSIVE c AS (SELECT event_id AS id, CASE WHEN event_id % 16 <> 0 THEN event_id - 1 END AS parent FROM events), w AS (SELECT id AS head, id, parent, 0 AS generation FROM c
  UNION ALL SELECT w.head, c.id, c.parent, w.generation + 1 FROM w JOIN c ON c.id = w.parent) SELECT head, id, generation::INTEGER AS generation FROM w""")
def commit_chains(spark, sf):
    """Parents of every event, back to the root of its chain of sixteen."""
    e = v.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 16 != 0, F.col("event_id") - 1).alias("parent_id"))
    return graph.ancestors(e, e.select("id"))


@query("SELECT DISTINCT source AS name FROM documents UNION ALL SELECT 'made'")
def repository_created(spark, sf):
    repos = v.table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").cast("int").alias("id")).select("id", "name", F.lit(None).cast("string").alias("description"), F.lit(v.AS_OF).cast("timestamp_ntz").alias("created_at"))
    return upserts.create_repository(repos, "made", None, v.AS_OF).select("name")


# --- lines of the tools, write-back of vectors, small filters -----------------------------------------------------------


@query(f"""WITH {v.BLOBS} SELECT id, '--- Match (Score: ' || printf('%.3f', (id % 1000) / 1000.0::DOUBLE) || ')' || CASE WHEN id % 3 = 0 THEN ' [Graph Bridge via src/a.js]' ELSE '' END || ' | [' || repo || '] ' || file_name ||
  coalesce(' | Path: ' || file_path, '') || ' | Seen: ' || coalesce(strftime(last_seen_at, '%Y-%m-%d'), 'unknown') || ' ---' || chr(10) || CASE WHEN coalesce(summary, '') = '' THEN '(no preview)' ELSE summary END AS line FROM v_blob""")
def tool_search_text(spark, sf):
    found = v.blobs(spark, sf).withColumn("similarity", F.col("id") % 1000 / 1000.0).withColumn("via", F.when(F.col("id") % 3 == 0, "src/a.js"))
    return found.select("id", answers.match_text().alias("line"))


@query(f"""WITH {v.SYMBOLS} SELECT id, '--- [' || repo || '] ' || file_path || ':' || start_line || '-' || end_line || ' | ' || upper(symbol_type) || ': ' || symbol_name || coalesce(' | hash:' || left(symbol_hash, 12), '') || ' ---' || chr(10) || 'Signature: ' || signature ||
  chr(10) || 'Preview:' || chr(10) || left(repeat(content || ' ', 1 + id % 20), 300) || CASE WHEN length(repeat(content || ' ', 1 + id % 20)) > 300 THEN '...' ELSE '' END AS line,
  '• L' || start_line || '-L' || end_line || ' [' || symbol_type || '] ' || symbol_name || coalesce(' (hash:' || left(symbol_hash, 12) || ')', '') || ': ' || signature AS declared FROM v_symbol""")
def tool_symbol_text(spark, sf):
    long = v.symbols(spark, sf).withColumn("content", F.repeat(F.concat("content", F.lit(" ")), (1 + F.col("id") % 20).cast("int")))
    return long.select("id", answers.symbol_text().alias("line"), answers.declared_text().alias("declared"))


@query(f"""WITH {v.BLOBS}, n AS (SELECT id, list_reverse(embedding) AS found FROM v_blob WHERE embedding IS NOT NULL AND embed_model IS DISTINCT FROM 'active')
  SELECT form, b.id, CASE WHEN found IS NOT NULL AND form = 'named' THEN 'next' ELSE embed_model END AS embed_model, coalesce(found, embedding)[1] AS head FROM v_blob b LEFT JOIN n ON n.id = b.id CROSS JOIN (VALUES ('named'), ('plain')) f(form)""")
def vector_write_back(spark, sf):
    """Vectors written back in both forms: with the model's name, and the vector alone."""
    old = v.blobs(spark, sf).select("id", "embedding", "embed_model")
    new = old.where(~F.col("embed_model").eqNullSafe(F.lit("active"))).select("id", F.reverse("embedding").alias("embedding"))
    one = lambda form, model: upserts.write_vectors(old, new, model).select(F.lit(form).alias("form"), "id", "embed_model", F.get("embedding", F.lit(0)).alias("head"))
    return one("named", "next").unionByName(one("plain", None))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN lang <> 'en' ELSE false END AS skipped FROM documents")
def translation_skip(spark, sf):
    at = F.when(F.col("doc_id") % 3 == 0, F.lit("translated_images/a.png")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("translations/"), "lang", F.lit("/readme.md"))).otherwise(F.concat(F.lit("docs/translations/"), "lang"))
    return v.table(spark, sf, "documents").select("doc_id", filters.is_translation(at).alias("skipped"))


@query("SELECT doc_id, doc_id % 5 IN (0, 1) AS odd FROM documents WHERE length(text) > 0")
def control_characters(spark, sf):
    """A control character among the first 200 counts, white space and what comes later do not."""
    mark = F.when(F.col("doc_id") % 5 == 0, F.char(F.lit(7))).when(F.col("doc_id") % 5 == 1, F.char(F.lit(31))).when(F.col("doc_id") % 5 == 2, F.lit("\t\n")).when(F.col("doc_id") % 5 == 3, F.concat(F.repeat(F.lit("x"), F.lit(200)), F.char(F.lit(7)))).otherwise("")
    return v.table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", filters.has_control(F.concat(mark, "text")).alias("odd"))


@query("SELECT l_orderkey AS blob_id, round(avg((l_returnflag = 'N')::INTEGER), 6) AS unused_ratio, bool_or(l_returnflag = 'R') AS has_active FROM lineitem GROUP BY l_orderkey")
def unused_imports(spark, sf):
    state = F.when(F.col("l_returnflag") == "N", "unused_staged").when(F.col("l_returnflag") == "R", "immediate_cursor").otherwise("used")
    found = frames.unused_ratio(v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("blob_id"), state.alias("status")))
    return found.withColumn("unused_ratio", r6(F.col("unused_ratio")))


@query(r"""SELECT p_partkey, 'get HTTPServer of ' || replace(replace(replace(p_type, ' ', '_'), '/', ' '), '-', ' ') || ' ' || p_name AS shape FROM part""")
def stored_names(spark, sf):
    """Camel words come apart at a small letter or digit before a capital only; delimiters turn to blanks."""
    name = F.concat(F.lit("getHTTPServer.of-"), F.replace("p_type", F.lit(" "), F.lit("~")), F.lit("/"), "p_name")
    return v.table(spark, sf, "part").select("p_partkey", F.replace(text.delimiter_split(name), F.lit("~"), F.lit("_")).alias("shape"))


# --- substrings, many identifiers, vectors in batches, the tools' longer texts -------------------------------------------


@query("""WITH q AS (SELECT DISTINCT lower(substr(text, 101, 8 + doc_id % 5)) AS needle FROM documents WHERE doc_id % 20 = 0 AND length(substr(text, 101, 8)) = 8)
  SELECT needle, count(*) AS n_rows, min(doc_id) AS first_id FROM q JOIN documents d ON contains(lower(d.text), needle) GROUP BY needle""")
def trigram_contains(spark, sf):
    """Substrings from every document whose id is divisible by 20, looked up in all documents by the trigram index."""
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    needles = d.where("id % 20 = 0 and length(substr(text, 101, 8)) = 8").select(F.expr("substr(text, 101, 8 + id % 5)").alias("needle"))
    return substrings.build(d, scratch(spark, "trigrams")).counts(needles, d)


@query(r"""WITH p AS (SELECT DISTINCT lower(x) AS pattern FROM (SELECT unnest(regexp_extract_all(html, '[a-zA-Z_$][a-zA-Z0-9_$]{3,}')) AS x FROM pages UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT p_name FROM part) u WHERE x <> ''),
  h AS (SELECT pattern, count(*) AS n FROM p JOIN documents d ON contains(lower(d.text), pattern) GROUP BY pattern) SELECT p.pattern, coalesce(n, 0) AS n_rows FROM p LEFT JOIN h ON h.pattern = p.pattern""")
def identifier_counts(spark, sf):
    """How many documents hold each identifier of the pages and parts: one pass over the texts for all of them."""
    part = v.table(spark, sf, "part")
    named = v.table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("[a-zA-Z_$][a-zA-Z0-9_$]{3,}"), F.lit(0))).alias("pattern"))
    asked = named.unionByName(part.select(F.explode(F.split("p_name", " ")).alias("pattern"))).unionByName(part.select(F.col("p_name").alias("pattern")))
    asked = asked.select(F.lower("pattern").alias("pattern")).where("pattern <> ''").distinct()
    found = patterns.counts(v.table(spark, sf, "documents").select("text"), asked)
    return asked.join(found, "pattern", "left").select("pattern", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents), h AS (SELECT *, CASE WHEN NOT regexp_matches(t, '[^ \t\n\r\f\v]') THEN 'blank' WHEN n // 16 > 300 THEN 'overflow' ELSE 'ok' END AS status,
    CASE WHEN n <= 300 THEN 0 WHEN n // 2 <= 300 THEN 1 WHEN n // 4 <= 300 THEN 2 WHEN n // 8 <= 300 THEN 3 ELSE 4 END AS halvings FROM n), u AS (SELECT *, CASE WHEN status = 'ok' THEN n // (1 << halvings) ELSE 0 END AS used FROM h)
  SELECT doc_id, status, CASE WHEN status = 'blank' THEN 0 ELSE halvings END::INTEGER AS halvings, used::INTEGER AS used, CASE WHEN status = 'ok' THEN round(('0x' || substr(sha256(left(t, used)), 1, 4))::INTEGER / 65535.0::DOUBLE * 2 - 1, 6) END AS head FROM u""")
def embedded_documents(spark, sf):
    """Vectors of all documents through a stand-in model with a context of 300 characters, so that most texts overflow and are halved."""
    out = embedding.embed(v.table(spark, sf, "documents"), "doc_id", "text", embedding.stand_in(16, 300))
    return out.select(F.col("id").alias("doc_id"), "status", "halvings", "used", r6(F.get("vector", F.lit(0))).alias("head"))


_QUEUED = "CASE WHEN id % 4 = 0 THEN replace(file_name, '.txt', '.md') ELSE file_name END"


@query(f"""WITH {v.BLOBS} SELECT id, (row_number() OVER (ORDER BY ends_with({_QUEUED}, '.md') DESC, size, id))::INTEGER AS place FROM v_blob WHERE summary IS NULL AND content IS NOT NULL AND size > 30 AND size < 50000 QUALIFY place <= 20""")
def tag_queue(spark, sf):
    """The twenty files that are summarised next."""
    b = v.blobs(spark, sf).withColumn("file_name", F.when(F.col("id") % 4 == 0, F.replace("file_name", F.lit(".txt"), F.lit(".md"))).otherwise(F.col("file_name")))
    return filters.tag_queue(b, 20).select("id", F.row_number().over(Window.orderBy(~F.endswith("file_name", F.lit(".md")), "size", "id")).alias("place"))


@query("SELECT page_id, page_id % 4 NOT IN (0, 1) AS taken FROM pages")
def file_filter(spark, sf):
    """Excluded path prefixes and files that crash the server; a prefix ends where a part of a path ends."""
    kind, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    at = F.when(kind == 0, F.concat(F.lit("docs/projects/a"), i, F.lit(".md"))).when(kind == 1, F.concat(F.lit("lib/"), i, F.lit("/package-lock.json"))).when(kind == 2, F.concat(F.lit("docs/projects-"), i, F.lit("/a.md"))).otherwise(F.concat(F.lit("lib/docs/projects/"), i, F.lit(".md")))
    return v.table(spark, sf, "pages").select("page_id", filters.is_taken(at, ("docs/projects",)).alias("taken"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), w AS (
    SELECT doc_id, a, 1 AS n, 0 AS part, a[1] || chr(10) AS piece FROM l
    UNION ALL SELECT doc_id, a, n + 1, CASE WHEN cut THEN part + 1 ELSE part END, CASE WHEN cut THEN line ELSE piece || line END FROM (
      SELECT *, CASE WHEN (n + 1) % 3 = 0 THEN '## ' WHEN (n + 1) % 3 = 1 THEN '### ' ELSE '' END || a[n + 1] || chr(10) AS line, (n + 1) % 3 = 0 AND length(piece) > 400 AS cut FROM w WHERE n < len(a)) z)
  SELECT doc_id, part::INTEGER AS part, md5(arg_max(piece, n)) AS digest FROM w GROUP BY doc_id, part HAVING regexp_matches(arg_max(piece, n), '\S')""")
def markdown_parts(spark, sf):
    """Long documents cut at headings of the first two levels, which every third line is made here."""
    headed = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.when((i + 1) % 3 == 0, "## ").when((i > 0) & ((i + 1) % 3 == 1), "### ").otherwise(""), line))
    d = v.table(spark, sf, "documents").select("doc_id", F.array_join(headed, "\n").alias("text"))
    return d.select("doc_id", F.posexplode(formats.markdown_parts(F.col("text"), 400)).alias("part", "piece")).select("doc_id", "part", F.md5("piece").alias("digest"))


@query(f"""WITH {v.BLOBS}, {v.IMPORTS}, {v.SYMBOLS}, s AS (SELECT DISTINCT ON (start_line, symbol_name, symbol_type) * FROM v_symbol WHERE file_path = 'src/d2.txt' ORDER BY start_line, symbol_name, symbol_type, id DESC),
  up AS (SELECT DISTINCT ON (target_path, relation) * FROM v_import WHERE source_path = 'src/d2.txt' ORDER BY target_path, relation, id DESC),
  down AS (SELECT DISTINCT ON (source_path, relation) * FROM v_import WHERE target_path = 'src/d2.txt' OR ends_with(lower(target_path), 'src/d2.txt') OR contains(lower(target_path), 'd2') ORDER BY source_path, relation, id DESC),
  lines AS (SELECT 2 AS section, start_line::VARCHAR AS k, id, '  • [' || symbol_type || '] ' || symbol_name || ' (L' || start_line || '-L' || end_line || ')' || coalesce(' [hash:' || left(symbol_hash, 12) || ']', '') AS line FROM s
    UNION ALL SELECT 3, target_path, id, '  • ' || relation || ': ' || target_path || ' [' || replace(symbols, ' ', ', ') || ']' FROM up UNION ALL SELECT 4, source_path, id, '  • ' || source_path || ' (' || relation || ') [' || replace(symbols, ' ', ', ') || ']' FROM down),
  heads(section, name) AS (VALUES (2, '📦 Declared Symbols'), (3, '➡️ Outbound Imports'), (4, '⬅️ Inbound Dependents')), n AS (SELECT h.section, name, count(l.id) AS n FROM heads h LEFT JOIN lines l ON l.section = h.section GROUP BY h.section, name)
  SELECT 0 AS section, 0::BIGINT AS place, '=== 🕸️ Dependency Graph for src/d2.txt ===' AS line UNION ALL SELECT section, 0, name || ' (' || n || '):' FROM n UNION ALL SELECT section, 1, '  (none)' FROM n WHERE n = 0
  UNION ALL SELECT section, row_number() OVER (PARTITION BY section ORDER BY k, id), line FROM lines""")
def tool_dependency_text(spark, sf):
    return _engine(spark, sf).dependency_text("src/d2.txt")
