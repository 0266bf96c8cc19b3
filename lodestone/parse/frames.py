"""Parsing as DataFrame operators: one Arrow pass over the files, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.parse.activity import activity
from lodestone.parse.languages import parse

_SYMBOL = "symbol_name string, symbol_type string, start_line int, end_line int, signature string, content string, symbol_hash string"
_FILE = "blob_id string, file_path string"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (id, file_path, content); names are cut to 255 characters."""
    schema = pa.schema([(n, pa.int32() if n.endswith("_line") else pa.string()) for n in ("blob_id", "file_path", "symbol_name", "symbol_type", "start_line", "end_line", "signature", "content", "symbol_hash")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, path, s.name[:255], s.type, s.start_line, s.end_line, s.signature, s.content, s.symbol_hash) for i, path, text in _rows(b) for s in parse(text, path)[0]]
            yield _table(rows, schema)

    return files.select(F.col("id").cast("string"), "file_path", "content").mapInArrow(run, f"{_FILE}, {_SYMBOL}")


def edges(files: DataFrame) -> DataFrame:
    """Import edges of files (id, file_path, content)."""
    schema = pa.schema([(n, pa.string()) for n in ("blob_id", "file_path", "target_path", "relation")] + [("symbols", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _table([(i, path, x.target_path, x.relation, x.symbols) for i, path, text in _rows(b) for x in parse(text, path)[1]], schema)

    return files.select(F.col("id").cast("string"), "file_path", "content").mapInArrow(run, f"{_FILE}, target_path string, relation string, symbols array<string>").withColumnRenamed("file_path", "source_path")


def import_activity(files: DataFrame) -> DataFrame:
    """Bindings of files (id, file_path, content) with their status."""
    names = ("blob_id", "file_path", "local_name", "exported_name", "module", "target_path", "status")
    schema = pa.schema([(n, pa.string()) for n in names] + [("via_receiver", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _table([(i, path, x.local_name, x.exported_name, x.module, x.target_path, x.status, x.via_receiver) for i, path, text in _rows(b) for x in activity(text, None, path)], schema)

    return files.select(F.col("id").cast("string"), "file_path", "content").mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", via_receiver boolean")


def unused_ratio(bindings: DataFrame) -> DataFrame:
    """Per file the share of its bindings that are not used yet."""
    return bindings.groupBy("blob_id").agg(F.avg((F.col("status") == "unused_staged").cast("double")).alias("unused_ratio"), F.bool_or(F.col("status") == "immediate_cursor").alias("has_active"))


#: Characters that part the words of a route, and words of a declaration that tell nothing about it.
ROUTE_BREAKS, DECLARING = " \t\n\r/,:{}()'\"`[]@?=&#*+!~<>|\\", ("def", "async", "function")


def spine(symbol_rows: DataFrame) -> DataFrame:
    """Per blob its distinct names, and the words of its routes, in order; at most 4000 characters."""
    name = F.trim(F.regexp_replace("symbol_name", r"\s+", " "))
    words = F.filter(F.split(F.translate(F.concat_ws(" ", "symbol_name", "signature"), ROUTE_BREAKS, " " * len(ROUTE_BREAKS)), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*DECLARING))
    parts = F.when(F.col("symbol_type") == "route", F.concat(F.array(name), words)).otherwise(F.array(name))
    kept = symbol_rows.select("blob_id", F.struct("start_line", "end_line", "symbol_name", F.filter(parts, lambda p: p != "").alias("p")).alias("s"))
    return kept.groupBy("blob_id").agg(F.left(F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]))), " "), F.lit(4000)).alias("symbol_spine"))
