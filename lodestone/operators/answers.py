"""Result rows as the text lines that the tools show; one expression each, so that formatting stays with the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lines of a tool's text, the characters shown of a hash and of a preview.
MATCH = "--- Match (Score: %.3f)%s | %s %s%s | Seen: %s ---\n%s"
SYMBOL = "--- %s%s:%d-%d | %s: %s%s ---"
DECLARED = "• L%d-L%d [%s] %s%s: %s"
FOCUS, LISTED, OUTBOUND, INBOUND = "  • [%s] %s (L%d-L%d)%s%s", "  • [%s] %s (L%d-L%d)%s", "  • %s: %s%s", "  • %s (%s)%s"
HASH_SHOWN, PREVIEW_SHOWN = 12, 300


def _part(before: str, c: str | Column, after: str = "", instead: str = "") -> Column:
    """A value with its marks, or ``instead`` where it is null or empty."""
    value = F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(instead))


def match_text() -> Column:
    """A file found: needs similarity, via (the bridge it came by, or null), repo, file_name, file_path, last_seen_at, summary."""
    seen = _part("", F.date_format("last_seen_at", "yyyy-MM-dd"), instead="unknown")
    return F.format_string(MATCH, F.col("similarity").cast("double"), _part(" [Graph Bridge via ", "via", "]"), _part("[", "repo", "]"), _part("", "file_name"), _part(" | Path: ", "file_path"), seen, _part("", "summary", instead="(no preview)"))


def symbol_text() -> Column:
    """A symbol found, with its signature and the begin of its content where it has them."""
    head = F.format_string(SYMBOL, _part("[", "repo", "] "), "file_path", "start_line", "end_line", F.upper("symbol_type"), "symbol_name", _part(" | hash:", F.left("symbol_hash", F.lit(HASH_SHOWN))))
    cut = F.when(F.length("content") > PREVIEW_SHOWN, F.concat(F.left("content", F.lit(PREVIEW_SHOWN)), F.lit("..."))).otherwise(F.col("content"))
    return F.concat(head, _part("\nSignature: ", "signature"), _part("\nPreview:\n", cut))


def declared_text() -> Column:
    """A symbol in the list of a file's symbols."""
    return F.format_string(DECLARED, "start_line", "end_line", "symbol_type", "symbol_name", _part(" (hash:", F.left("symbol_hash", F.lit(HASH_SHOWN)), ")"), _part("", "signature"))


def _symbols() -> Column:
    return _part(" [", F.array_join("symbols", ", "), "]")


def _hash(before: str, after: str = "") -> Column:
    return _part(before, F.left("symbol_hash", F.lit(HASH_SHOWN)), after)


def dependency_lines(path: str, parts: dict[str, DataFrame], focus: str | None = None) -> DataFrame:
    """(section, place, line) of the text that shows a file's dependencies; a section's heading, with its count, is at place 0.

    Sections: 0 the title, 1 the definitions of the symbol ``focus`` in any case (only if there are any), 2 symbols, 3 imports,
    4 dependents. ``parts`` are the frames of the dependency tool; lines stay rows, since a file may have dependents without bound.
    """
    symbols, imports, dependents = parts["symbols"], parts["imports"], parts["dependents"]
    listed = F.format_string(LISTED, "symbol_type", "symbol_name", "start_line", "end_line", _hash(" [hash:", "]"))
    known = [
        (2, "\U0001f4e6 Declared Symbols", symbols.select(F.col("start_line").alias("by"), "id", listed.alias("line"))),
        (3, "\u27a1\ufe0f Outbound Imports", imports.select(F.col("target_path").alias("by"), "id", F.format_string(OUTBOUND, "relation", "target_path", _symbols()).alias("line"))),
        (4, "\u2b05\ufe0f Inbound Dependents", dependents.select(F.col("source_path").alias("by"), "id", F.format_string(INBOUND, "source_path", "relation", _symbols()).alias("line"))),
    ]
    about = f" (focus: {focus})" if focus else ""
    title = f"=== \U0001f578\ufe0f Dependency Graph for {path}{about} ==="
    out = symbols.sparkSession.createDataFrame([(0, 0, title)], "section int, place long, line string")
    if focus:
        told = F.format_string(FOCUS, F.upper("symbol_type"), "symbol_name", "start_line", "end_line", _hash(" | hash:"), _part(" | ", "signature"))
        found = symbols.where(F.lower("symbol_name") == focus.lower()).select(F.col("start_line").alias("by"), "id", told.alias("line"))
        head = found.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("place"), F.lit("\U0001f3af Target Symbol Definition:").alias("line"))
        out = out.unionByName(head).unionByName(_numbered(found, 1))
    for section, name, rows in known:
        count = rows.agg(F.count(F.lit(1)).alias("n"))
        lines = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.concat(F.lit(f"{name} ("), "n", F.lit("):")).alias("line")), F.struct(F.lit(1).cast("long").alias("place"), F.when(F.col("n") == 0, "  (none)").alias("line")))
        heads = count.select(F.explode(lines).alias("x")).where("x.line is not null").select(F.lit(section).alias("section"), "x.*")
        out = out.unionByName(heads).unionByName(_numbered(rows, section))
    return out


def _numbered(rows: DataFrame, section: int) -> DataFrame:
    """Lines of a section in order; the rows are those of one file's answer."""
    return rows.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy("by", "id")).cast("long").alias("place"), "line")
