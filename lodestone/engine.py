"""One object over the tables of the model, with a method per tool; each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import answers, graph, lexical, ranking
from lodestone.sources import files

#: Default and greatest number of results by tool.
LIMITS = {"search": (5, 50), "symbols": (10, 100)}


def clamp(k: int | None, tool: str) -> int:
    default, most = LIMITS[tool]
    return default if k is None else min(max(1, k), most)


class Engine:
    def __init__(self, repositories: DataFrame, blobs: DataFrame, symbols: DataFrame, edges: DataFrame, trees: DataFrame | None = None, text_index: lexical.TextIndex | None = None):
        self.repositories, self.blobs, self.symbols, self.edges, self.trees, self.text_index = repositories, blobs, symbols, edges, trees, text_index

    def list_repos(self) -> DataFrame:
        return self.repositories.orderBy(F.desc("created_at"), "id")

    def resolve_repo(self, name: str | int) -> str:
        """A repository's name from its id, its name, its number as text, or its name in any case without an owner in front."""
        asked, low = str(name), str(name).lower()
        bare = F.lower(F.substring_index("name", "/", -1))
        fits = F.when(F.col("name") == asked, 0).when(F.col("id").cast("string") == asked, 1).when(F.lower("name") == low, 2).when(bare == low.rsplit("/", 1)[-1], 3)
        row = self.repositories.withColumn("fits", fits).where("fits is not null").orderBy("fits", "id").first()
        if row is None:
            raise ValueError(f"no repository {name!r}")
        return row["name"]

    def _scope(self, df: DataFrame, repo: str | int | None) -> DataFrame:
        return df if repo is None else df.where(F.col("repo") == self.resolve_repo(repo))

    def read_tree(self, tree_id: str) -> DataFrame:
        if self.trees is None:
            raise ValueError("no trees")
        return self.trees.where(F.col("tree_id") == tree_id).orderBy("name")

    def read_blob(self, path: str, repo: str | int | None = None) -> DataFrame:
        """The newest version of a path as a tool shows it."""
        clean = path.lstrip("/")
        hit = F.col("file_path").isin(clean, path) | (F.col("file_name") == clean)
        return self._scope(self.blobs, repo).where(hit).orderBy(F.desc_nulls_first("last_seen_at"), F.desc("id")).limit(1).withColumn("content", files.shown(F.col("content")))

    def semantic_search(self, text: str | None = None, vector: Sequence[float] | None = None, as_of: datetime | None = None, repo: str | int | None = None, k: int | None = None, mode: str = "hybrid", bridges: bool = False) -> DataFrame:
        """Ranked files; with ``bridges``, files one import away may join them if they hold what the others miss."""
        name, n, blobs = None if repo is None else self.resolve_repo(repo), clamp(k, "search"), self._scope(self.blobs, repo)
        found = ranking.search(blobs, as_of or datetime.now(UTC).replace(tzinfo=None), text, vector, mode, n, index=self.text_index, scoped=repo is not None)
        if not bridges or not text:
            return found
        told = found.select("id", "similarity").join(blobs, "id").select("id", "repo", *graph.ROW_TEXTS, "similarity").orderBy(F.desc("similarity"), "id")
        rows = graph.expand([r.asDict() for r in told.collect()], text, blobs, self._scope(self.edges, repo), n, name)
        schema = told.schema.add("bridge", "boolean").add("via", "string")
        return self.blobs.sparkSession.createDataFrame([tuple(r.get(c) if c != "bridge" else bool(r.get(c)) for c in schema.names) for r in rows], schema)

    def search_symbols(self, query: str, symbol_type: str | None = None, repo: str | int | None = None, k: int | None = None, vector: Sequence[float] | None = None) -> DataFrame:
        return ranking.symbol_search_with_meaning(self._scope(self.symbols, repo), query, vector, clamp(k, "symbols"), symbol_type)

    def file_symbols(self, path: str, repo: str | int | None = None) -> DataFrame:
        return graph.symbols_of(self._scope(self.symbols, repo), path)

    def dependency_graph(self, path: str, repo: str | int | None = None) -> dict[str, DataFrame]:
        """What a file declares, what it imports and what imports it."""
        e = self._scope(self.edges, repo)
        return {"symbols": self.file_symbols(path, repo), "imports": graph.imports_of(e, path), "dependents": graph.dependents_of(e, path)}

    def dependency_text(self, path: str, repo: str | int | None = None, focus: str | None = None) -> DataFrame:
        """The lines that show it: (section, place, line)."""
        return answers.dependency_lines(path, self.dependency_graph(path, repo), focus)

    def symbol_graph(self, name: str, repo: str | int | None = None) -> dict[str, DataFrame]:
        """The dependency graph of the file that declares a symbol."""
        row = ranking.symbol_lookup(self._scope(self.symbols, repo), name).first()
        if row is None:
            raise ValueError(f"no symbol {name!r}")
        return self.dependency_graph(row["file_path"], row["repo"] if "repo" in row.asDict() else repo)
