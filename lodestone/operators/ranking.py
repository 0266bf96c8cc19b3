"""Hybrid, dense, keyword and symbol retrieval.

Candidate limits come first (``TakeOrderedAndProject``), so every later window and join sees a few hundred rows; wide
columns join last. Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text, vector
from lodestone.operators import ann, lexical
from lodestone.operators.stages import stored
from lodestone.operators.versions import drop_superseded

#: Rank constant, decay per day, candidates before and after the version check, floor of keyword scores.
RRF_K, DECAY, FLOOR = 60.0, 0.01, 0.1
HAYSTACK = ("file_name", "file_path", "symbol_spine", "summary", "content")


def first_cut(k: int) -> int:
    return max(150, 20 * k)


def second_cut(k: int) -> int:
    return max(60, 10 * k)


def age_days(as_of: datetime, seen: str = "last_seen_at", created: str = "created_at") -> Column:
    gap = F.lit(as_of).cast("timestamp_ntz") - F.coalesce(F.col(seen), F.col(created))
    part = lambda what: F.extract(F.lit(what), gap).cast("double")
    return part("DAY") + part("HOUR") / 24.0 + part("MINUTE") / 1440.0 + part("SECOND") / 86400.0


def decay(as_of: datetime) -> Column:
    return F.exp(-DECAY * age_days(as_of))


def searchable(model: str = "active") -> Column:
    return F.col("embedding").isNotNull() & (F.col("embed_model").isNull() | (F.col("embed_model") == model))


def _vector(query: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def haystack() -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in HAYSTACK])


def _narrow(blobs: DataFrame, score: Column, k: int, where: Column) -> DataFrame:
    """The best rows, scored once: the checkpoint keeps their scan from running again for the version check, and nulls sort last, so that
    no filter pulls the score's expression apart."""
    scored = blobs.where(where).select("id", "repo", "file_path", "last_seen_at", "created_at", score.alias("raw"))
    return stored(scored.orderBy(F.desc_nulls_last("raw"), "id").limit(first_cut(k))).where("raw is not null")


def dense_matches(blobs: DataFrame, query: Sequence[float], k: int, model: str = "active", near: ann.VectorIndex | None = None) -> DataFrame:
    """(id, raw, rank) of the nearest vectors whose file has no newer version. ``near``: an index of the searchable vectors, in place of the scan."""
    if near is not None:
        asked = blobs.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, vector array<double>")
        found = stored(near.search(asked, first_cut(k)).select("id", F.col("cosine").alias("raw")))
        top = _versions(blobs).join(F.broadcast(found.limit(first_cut(k))), "id")
    else:
        top = _narrow(blobs, vector.cosine(F.col("embedding"), _vector(query)), k, searchable(model))
    return _ranked(drop_superseded(top, blobs, first_cut(k)), k)


def vector_index(blobs: DataFrame, path: str, model: str = "active") -> ann.VectorIndex:
    """Write an index of the blobs' searchable vectors."""
    return ann.build(blobs.sparkSession, blobs.where(searchable(model)).select("id", F.col("embedding").alias("vector")), path)


def lexical_matches(blobs: DataFrame, query: str, k: int, scorer: str = "cover", index: lexical.TextIndex | None = None, scoped: bool = False) -> DataFrame:
    """(id, raw, rank) of the best texts whose file has no newer version, whatever their vector's model.

    ``scorer``: "cover" ranks the weighted index (``lexical``), which does not hold the content; "ratio" the share of the
    query's terms in name, path, spine, summary and content, which SQL can say. ``index``: the stored index of the blobs, which
    spares the search their texts; ``scoped`` if the blobs are only some of those that it holds.
    """
    if scorer == "ratio":
        top = _narrow(blobs, text.hit_ratio(haystack(), query), k, F.lit(True))
    elif index is not None and not scoped:
        found = F.broadcast(stored(index.top(query, first_cut(k))))
        top = _versions(blobs).join(found, "id").withColumnRenamed("score", "raw")
    else:
        found = index.scores(query) if index is not None else lexical.scores(blobs, query)
        top = _narrow(blobs.join(found, "id"), F.col("score"), k, F.lit(True))
    return _ranked(drop_superseded(top, blobs, first_cut(k)), k)


def _versions(blobs: DataFrame) -> DataFrame:
    return blobs.select("id", "repo", "file_path", "last_seen_at", "created_at")


def _scored(blobs: DataFrame, query: str, scorer: str, index: lexical.TextIndex | None) -> tuple[DataFrame, Column]:
    if scorer == "ratio":
        return blobs, text.hit_ratio(haystack(), query)
    found = index.scores(query) if index is not None else lexical.scores(blobs, query)
    return blobs.select("id", "repo", "file_name", "file_path", "last_seen_at", "created_at").join(found, "id", "left"), F.col("score")


def _ranked(df: DataFrame, k: int) -> DataFrame:
    cut = df.orderBy(F.desc("raw"), "id").limit(second_cut(k))
    return cut.select("id", "raw", F.row_number().over(Window.orderBy(F.desc("raw"), "id")).alias("rank"))


def hybrid_search(blobs: DataFrame, query_text: str, query_vector: Sequence[float], as_of: datetime, k: int = 10, scorer: str = "cover", index: lexical.TextIndex | None = None, scoped: bool = False) -> DataFrame:
    """Reciprocal rank fusion of both rankings, decayed by age."""
    d = dense_matches(blobs, query_vector, k).select("id", F.col("raw").alias("dense_sim"), F.col("rank").alias("dense_rank"))
    x = lexical_matches(blobs, query_text, k, scorer, index, scoped).select("id", F.col("raw").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    fused = d.join(x, "id", "full").withColumn("rrf", F.coalesce(1.0 / (RRF_K + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("lexical_rank")), F.lit(0.0)))
    wide = blobs.join(F.broadcast(fused.limit(2 * second_cut(k))), "id").withColumn("similarity", F.col("rrf") * decay(as_of))
    return wide.orderBy(F.desc_nulls_last("similarity"), "id").limit(k).select(
        "id", "repo", "file_name", "file_path", preview().alias("summary"), "similarity", vector.calibrate(F.coalesce("dense_sim", F.lit(0.0))).alias("dense_sim"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score")
    )


def preview() -> Column:
    return F.coalesce(F.col("summary"), F.left(F.col("content"), F.lit(500)))


def dense_search(blobs: DataFrame, query: Sequence[float], as_of: datetime, k: int = 10, model: str = vector.DEFAULT_MODEL, near: ann.VectorIndex | None = None) -> DataFrame:
    """Ordered and cut by raw cosine with decay; the calibrated score is added afterwards and does not reorder."""
    found = dense_matches(blobs, query, k, near=near)
    wide = blobs.join(F.broadcast(found), "id").withColumn("decayed", F.col("raw") * decay(as_of))
    shown = vector.calibrate(F.col("raw"), model, vector.is_sparse(_vector(query))) * decay(as_of)
    return wide.orderBy(F.desc_nulls_last("decayed"), "id").limit(k).select("id", "repo", "file_path", F.col("raw").alias("cosine"), "decayed", shown.alias("similarity"))


def keyword_search(blobs: DataFrame, query: str, as_of: datetime, k: int = 10, scorer: str = "cover", index: lexical.TextIndex | None = None) -> DataFrame:
    """Lexical score with a floor, or a name that contains the query, decayed; one cut, then the version check."""
    named = F.contains(F.lower("file_name"), F.lit(query.lower())) | F.contains(F.lower("file_path"), F.lit(query.lower()))
    rows, hit = _scored(blobs, query, scorer, index)
    score = text.bound(hit, lambda x: F.when(x.isNotNull() | F.coalesce(named, F.lit(False)), F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(FLOOR)))) * decay(as_of)
    top = drop_superseded(_narrow(rows, score, k, F.lit(True)), blobs, first_cut(k))
    return top.orderBy(F.desc("raw"), "id").limit(k).select("id", "repo", "file_path", F.col("raw").alias("similarity"))


def search(blobs: DataFrame, as_of: datetime, query_text: str | None = None, query_vector: Sequence[float] | None = None, mode: str = "hybrid", k: int = 10, scorer: str = "cover", index: lexical.TextIndex | None = None, scoped: bool = False) -> DataFrame:
    """The ladder of modes: hybrid, then dense if that is empty, then keywords; a vector outranks the keyword mode."""
    if not query_text and query_vector is None:
        raise TypeError("a query text or vector is needed")
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise TypeError("k must be a positive integer")
    k = min(k, 100)
    if query_vector is not None:
        if mode == "hybrid" and query_text:
            found = stored(hybrid_search(blobs, query_text, query_vector, as_of, k, scorer, index, scoped))
            if not found.isEmpty():
                return found
        found = stored(dense_search(blobs, query_vector, as_of, k))
        if not query_text or not found.isEmpty():
            return found
    return keyword_search(blobs, query_text, as_of, k, scorer, index)


def symbol_ranks(symbols: DataFrame, query: str, index: lexical.TextIndex | None = None) -> DataFrame:
    """``symbols`` that match, with their similarity: 1 for the same name, 0.85 for one that contains the query, else the cover
    density of all its words in the symbols' text index."""
    asked, name, low = lexical.symbols_asked(query), F.lower("symbol_name"), query.lower()
    found = index.scores(asked) if index is not None else lexical.score_hits(lexical.index_of_symbols(symbols), asked)
    similarity = F.when(name == low, 1.0).when(F.contains(name, F.lit(low)), 0.85).otherwise(F.col("score"))
    return symbols.join(found, "id", "left").withColumn("similarity", similarity).drop("score").where("similarity is not null")


def symbol_search(symbols: DataFrame, query: str, k: int = 10, symbol_type: str | None = None, repo: str | None = None, index: lexical.TextIndex | None = None) -> DataFrame:
    """The best symbols; of equal (repo, path, name, type, line) the first. An empty query has none."""
    query = query.strip()
    scoped = symbols if symbol_type is None else symbols.where(F.col("symbol_type") == symbol_type)
    scoped = scoped if repo is None else scoped.where(F.col("repo") == repo)
    order = [F.desc("similarity"), F.desc("id"), F.asc("start_line")]
    top = symbol_ranks(scoped, query, index).orderBy(*order).limit(2 * k) if query else scoped.withColumn("similarity", F.lit(0.0)).limit(0)
    key = ["repo", "file_path", "symbol_name", "symbol_type", "start_line"]
    first = top.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
    return first.orderBy(*order).limit(k)


def semantic_symbols(symbols: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """Nearest symbol vectors; dropped if the raw cosine is under 0.35 and the calibrated one under 0.55."""
    raw = vector.cosine(F.col("embedding"), _vector(query))
    top = symbols.where(searchable()).withColumn("raw", raw).orderBy(F.desc("raw"), "id").limit(k)
    return top.withColumn("calibrated", vector.calibrate(F.col("raw"))).where("raw >= 0.35 or calibrated >= 0.55")


def symbol_search_with_meaning(symbols: DataFrame, query: str, vector_: Sequence[float] | None, k: int = 10, symbol_type: str | None = None, repo: str | None = None) -> DataFrame:
    """The best symbols by name and text; nearest vectors follow behind them where there is room and the query has a blank, or where
    there is none at all. Columns of ``symbol_search``, ``place``."""
    found = stored(symbol_search(symbols, query, k, symbol_type, repo))
    n = found.count()
    order = Window.orderBy(F.desc("similarity"), F.desc("id"), "start_line")
    first = found.withColumn("place", F.row_number().over(order))
    if vector_ is None or n >= k or (n and " " not in query.strip()):
        return first
    scoped = symbols if symbol_type is None else symbols.where(F.col("symbol_type") == symbol_type)
    scoped = scoped if repo is None else scoped.where(F.col("repo") == repo)
    key = ["repo", "file_path", "symbol_name", "symbol_type", "start_line"]
    near = semantic_symbols(scoped, vector_, k).withColumn("similarity", F.col("calibrated")).drop("raw", "calibrated").join(F.broadcast(found.select(*key)), key, "left_anti")
    more = near.select(*found.columns).withColumn("place", F.row_number().over(order) + n)
    return first.unionByName(more).orderBy("place").limit(k)


def symbol_lookup(symbols: DataFrame, name: str) -> DataFrame:
    """The file of a symbol: any case, the exact one first, then the newest."""
    return symbols.where(F.lower("symbol_name") == name.lower()).orderBy((F.col("symbol_name") == name).desc(), F.desc("id")).limit(1)
