"""Content hashes of blobs, symbols, trees, commits and rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blob_hash(content: Column) -> Column:
    """Git's object id of a text: SHA-1 of 'blob', its size in bytes, NUL and the bytes."""
    return F.sha1(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.char(F.lit(0)), content))


def symbol_hash(text: Column) -> Column:
    """SHA-256 of the text with LF line ends and without outer white space."""
    return F.sha2(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", ""), 256)


def tree_hash(entries: Column) -> Column:
    """SHA-1 over 'type id name' lines in name order; ``entries``: array<struct<name, type, object_id>>."""
    body = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat_ws(" ", e["type"], e["object_id"], e["name"])), "\n")
    return F.sha1(F.concat(F.lit("tree "), F.length(body).cast("string"), F.char(F.lit(0)), body))


def commit_hash(tree_id: Column, message: Column) -> Column:
    body = F.concat(F.lit("tree "), tree_id, F.lit("\nmessage "), message)
    return F.sha1(F.concat(F.lit("commit "), F.length(body).cast("string"), F.char(F.lit(0)), body))


def row_id(*parts: Column) -> Column:
    """The first 12 digits of the MD5 of the joined parts."""
    return F.left(F.md5(F.concat_ws(":", *parts)), F.lit(12))
