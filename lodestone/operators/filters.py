"""Predicates over file names and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths

#: Extensions of files whose text is embedded.
TEXT_EXTENSIONS = (
    ".js .mjs .cjs .ts .jsx .tsx .json .md .txt .html .css .yml .yaml .sql .py .sh .go .rs .php .java .cs .rb .kt .toml "
    ".env .dockerfile .graphql .vue .svelte"
).split()
#: Folders that a walk never enters.
EXCLUDED_FOLDERS = (
    ".git node_modules dist dist-ext build __pycache__ .ruff_cache .mypy_cache data tmp .gemini .credentials .secrets .venv venv "
    "bench_venv mcp_env .vscode nodes sandbox logs sandbox-audits scratch mnt .agent .turbo .next out .nyc_output .source public r "
    "kaggle_games_our"
).split()
#: Files whose content an embedding server does not survive.
CRASHING_FILES = (
    "icons.tsx open-in-chat.tsx docs-copy-page.tsx ai-sdk-agents-patterns.tsx blocks-grid.tsx home-below-hero-layouts.tsx components.json "
    "package-lock.json ai-instructions-demo.json ai-instructions.json colors.ts blocks.ts"
).split()
#: Sources that get their summary first.
TAGGED_FIRST = r"\.(ts|js|tsx|jsx|py|md)$"
MAX_BINARY, MAX_TEXT, MAX_ANY = 100 * 1024, 500 * 1024, 50 * 1024 * 1024


def is_embeddable(name: Column) -> Column:
    return F.lower(paths.extname(name)).isin(*TEXT_EXTENSIONS)


def within_size(name: Column, size: Column) -> Column:
    """Text up to 500 KiB, anything else up to 100 KiB, nothing over 50 MiB."""
    return (size <= MAX_ANY) & F.when(is_embeddable(name), size <= MAX_TEXT).otherwise(size <= MAX_BINARY)


def is_walked(path: Column) -> Column:
    """No part of the path is an excluded folder or belongs to an installed Python environment."""
    odd = lambda p: p.isin(*EXCLUDED_FOLDERS, "site-packages") | F.contains(p, F.lit("venv")) | F.contains(p, F.lit("dist-info")) | F.contains(p, F.lit("egg-info"))
    return ~F.exists(F.split(path, "/"), odd)


def is_taken(path: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """The file is walked, is none that crashes the embedding server, and lies at or under none of ``prefixes``. A null path is not taken."""
    under = [(path == p) | F.startswith(path, F.lit(p + "/")) for p in (x.rstrip("/") for x in prefixes) if p]
    held = F.greatest(*under, F.lit(False)) if under else F.lit(False)
    return F.coalesce(is_walked(path) & ~held & ~F.element_at(F.split(path, "/"), -1).isin(*CRASHING_FILES), F.lit(False))


def is_translation(path: Column) -> Column:
    """A translated copy of a course: under translations/ but not the English one, or a translated image."""
    copy = F.startswith(path, F.lit("translations/")) & ~F.startswith(path, F.lit("translations/en/"))
    return F.coalesce(copy | F.startswith(path, F.lit("translated_images/")), F.lit(False))


def looks_binary(text: Column) -> Column:
    """Too short, several NULs, an encoded image, or a huge text of one or two lines."""
    n = F.length(text)
    image = F.startswith(text, F.lit("data:image")) | F.startswith(text, F.lit("iVBOR")) | F.startswith(text, F.lit("/9j/"))
    return (n < 20) | (F.length(F.regexp_replace(text, "[^\\x00]", "")) > 5) | image | ((F.size(F.split(text, "\n")) < 3) & (n > 5000))


def has_control(text: Column) -> Column:
    return F.rlike(F.left(text, F.lit(200)), F.lit("[\\x00-\\x08\\x0e-\\x1f]"))


def is_binary(content: Column) -> Column:
    """A NUL among the first 1024 characters."""
    return F.contains(F.left(content, F.lit(1024)), F.char(F.lit(0)))


def wants_tags(summary: Column, size: Column) -> Column:
    """No tagged summary yet (none, long, or without brackets) and a middling size."""
    return (summary.isNull() | (F.length(summary) >= 450) | ~F.rlike(summary, F.lit(r"(?s)\[.*\]"))) & (size > 30) & (size < 50_000)


def tag_queue(blobs: DataFrame, limit: int | None = None, repos: tuple[str, ...] = ()) -> DataFrame:
    """Files without a summary, of a middling size, sources first and small ones before large; of equal ones the least id."""
    found = blobs.where(F.col("summary").isNull() & F.col("content").isNotNull() & (F.col("size") > 30) & (F.col("size") < 50_000))
    found = found.where(F.col("repo").isin(*repos)) if repos else found
    ranked = found.orderBy((~F.coalesce(F.rlike("file_name", F.lit(TAGGED_FIRST)), F.lit(False))).cast("int"), "size", "id")
    return ranked if limit is None else ranked.limit(limit)


def contains_folded(a: Column, needle: str) -> Column:
    return F.contains(F.lower(a), F.lit(needle.lower()))
