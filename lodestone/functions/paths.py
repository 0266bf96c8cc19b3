"""POSIX path functions and the candidate keys by which import strings meet file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base names too common to identify a file by themselves.
GENERIC_BASENAMES = ("index", "main", "app", "utils", "config", "test", "types", "mod", "lib")
#: What may be appended to a bare import, and to a directory import.
BARE_SUFFIXES = ("", ".js", ".ts", ".py")
INDEX_FILES = ("/index.js", "/index.ts")


def strip_root(p: Column) -> Column:
    return F.regexp_replace(F.trim(p), r"^[/\\]+", "")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    """Everything before the last slash, '.' if there is none."""
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def extname(p: Column) -> Column:
    """The last dot of the base name and what follows; empty for dot files and names without one."""
    return F.regexp_extract(basename(p), r"^.+?(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    """The base name without its extension."""
    b = basename(p)
    return F.when(F.length(extname(p)) > 0, F.left(b, F.length(b) - F.length(extname(p)))).otherwise(b)


def normalise(p: Column) -> Column:
    """'.' and '..' folded; a path that climbs out of the root keeps its leading '..' parts."""
    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when((part == "") | (part == "."), acc).when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")


def resolved(source_path: Column, target: Column) -> Column:
    """A relative import joined to its source's folder, a bare one without leading slashes."""
    folder = F.when(F.contains(source_path, F.lit("/")), F.concat(dirname(source_path), F.lit("/"))).otherwise(F.lit(""))
    return F.when(F.startswith(target, F.lit("./")) | F.startswith(target, F.lit("../")), normalise(F.concat(folder, target))).otherwise(strip_root(target))


def is_external(target: Column) -> Column:
    return F.startswith(target, F.lit("node:"))


def suffixes(path: Column) -> Column:
    """The path and its proper suffixes of whole parts: keys by which a bare import may name it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))


def whole_names(path: Column) -> Column:
    """The path, the path up to each dot of its base name, and its folder if it is an index file."""
    base = basename(path)
    folder = F.left(path, F.length(path) - F.length(base))
    dots = F.size(F.split(base, r"\.")) - 1
    cut = F.when(dots > 0, F.transform(F.sequence(F.lit(1), dots), lambda n: F.concat(folder, F.array_join(F.slice(F.split(base, r"\."), 1, n), ".")))).otherwise(F.array().cast("array<string>"))
    index = F.when(F.startswith(base, F.lit("index.")) & (folder != ""), F.left(path, F.length(folder) - 1))
    return F.array_distinct(F.array_compact(F.concat(F.array(path, index), F.filter(cut, lambda c: c != folder))))


def document_id(repo: Column, source_path: Column, target: Column) -> Column:
    """'repo::path' of an import's target inside the repository, 'repo::pkg:name' of an external one; null for nothing."""
    t = F.replace(F.trim(target), F.lit("\\"), F.lit("/"))
    name = F.coalesce(F.nullif(F.regexp_replace(F.trim(repo), "[^a-zA-Z0-9._-]+", "_"), F.lit("")), F.lit("default"))
    inside = F.startswith(t, F.lit("./")) | F.startswith(t, F.lit("../"))
    at = F.when(inside, F.regexp_replace(resolved(source_path, t), r"^(\.\./)+", "")).when(F.startswith(t, F.lit("/")), F.regexp_replace(t, "^/+", "")).otherwise(F.concat(F.lit("pkg:"), t))
    return F.when(t != "", F.concat(name, F.lit("::"), at))
