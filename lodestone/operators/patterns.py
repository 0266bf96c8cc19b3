"""Many identifiers looked up in texts in one pass: an Aho-Corasick automaton per part of the patterns.

Patterns are dealt into parts of at most ``PART`` patterns and ``CHARACTERS`` characters on average, as many as a worker's memory
holds as an automaton; a part goes to every task as one Arrow array, each worker makes its automaton once, and a text is read once
for all patterns of a part. Occurrences may overlap and lie inside words, as with ``contains``; texts and patterns are compared in
lower case.

Defined results: null and empty patterns match nothing; repeated patterns are folded; null and empty texts hold nothing; without
patterns or rows nothing is found. A pattern that nothing holds has no row in ``holders``, ``counts`` and ``tallies``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.stages import stored

#: Patterns and characters in one automaton on average, patterns made into Python's strings at once, and pairs of one Arrow batch.
PART, CHARACTERS, SLICE, PAIRS = 1_000_000, 16 << 20, 1 << 16, 1 << 16


@dataclass(frozen=True)
class _Part:
    """Patterns of one automaton, told from others by their key."""

    key: str
    patterns: pa.Array = field(compare=False)


@functools.lru_cache(maxsize=1)
def _automaton(part: _Part) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for at in range(0, len(part.patterns), SLICE):
        for i, p in enumerate(part.patterns.slice(at, SLICE).to_pylist()):
            made.add_word(p, at + i)
    made.make_automaton()
    return made


def _held(b: pa.RecordBatch, part: _Part) -> Iterator[tuple[int, np.ndarray]]:
    """Each row that holds a pattern, with the numbers of those that it holds."""
    found = _automaton(part)
    for row, t in enumerate(b.column(b.num_columns - 1)):
        if (text := t.as_py()) and (held := {i for _, i in found.iter(text)}):
            yield row, np.fromiter(held, np.int64, len(held))


def _pairs(part: _Part):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, held in _held(b, part):
                for at in range(0, len(held), PAIRS):
                    cut = held[at : at + PAIRS]
                    yield pa.record_batch([b.column(0).take(pa.array([row] * len(cut))), part.patterns.take(pa.array(cut))], ["id", "pattern"])

    return work


def _totals(part: _Part, firsts: bool):
    """Rows of a task by pattern; with ``firsts``, the least id of each pattern's rows too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(len(part.patterns), np.int64), None
        for b in batches:
            if firsts:  # the least id comes last and stays
                b = b.take(pc.array_sort_indices(b.column(0), order="descending", null_placement="at_start"))
            last = np.full(len(total), -1)
            for row, held in _held(b, part):
                total[held] += 1
                last[held] = row
            if firsts:
                least = b.column(0).take(pa.array(last, mask=last < 0))
                first = least if first is None else pc.min_element_wise(first, least)
        told = pa.array(np.flatnonzero(total))
        if len(told):
            out = {"pattern": part.patterns.take(told), "n_rows": pa.array(total).take(told)}
            yield pa.RecordBatch.from_pydict(out | {"first_id": first.take(told)} if firsts else out)

    return work


def _parts(patterns: DataFrame, part: int) -> Iterator[_Part]:
    """The distinct patterns in lower case, a part at a time."""
    folded = stored(patterns.select(F.lower("pattern").alias("pattern")).where("length(pattern) > 0").distinct())
    count, size = folded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    n = max(-(-count // part), -(-size // CHARACTERS))
    for i in range(n):
        held = folded.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).toArrow().column("pattern").combine_chunks()
        if len(held):
            yield _Part(uuid.uuid4().hex, held)


def holders(rows: DataFrame, patterns: DataFrame, part: int = PART) -> DataFrame:
    """(id, pattern): the patterns that each of the ``rows`` (id, text) holds, each once a row."""
    kind = dict(rows.dtypes)["id"]
    texts, shape = rows.select("id", F.lower("text").alias("text")), f"id {kind}, pattern string"
    out = rows.sparkSession.createDataFrame([], shape)
    for p in _parts(patterns, part):
        out = out.unionByName(texts.mapInArrow(_pairs(p), shape))
    return out


def counts(rows: DataFrame, patterns: DataFrame, part: int = PART) -> DataFrame:
    """(pattern, n_rows): how many of the ``rows`` (text) hold each pattern; a task emits each of its patterns once."""
    texts, shape = rows.select(F.lower("text").alias("text")), "pattern string, n_rows long"
    out = rows.sparkSession.createDataFrame([], shape)
    for p in _parts(patterns, part):
        out = out.unionByName(texts.mapInArrow(_totals(p, False), shape))
    return out.groupBy("pattern").agg(F.sum("n_rows").alias("n_rows"))


def tallies(rows: DataFrame, patterns: DataFrame, part: int = PART) -> DataFrame:
    """(pattern, n_rows, first_id): as ``counts``, with the least id of the ``rows`` (id, text) that hold it."""
    texts, shape = rows.select("id", F.lower("text").alias("text")), f"pattern string, n_rows long, first_id {dict(rows.dtypes)['id']}"
    out = rows.sparkSession.createDataFrame([], shape)
    for p in _parts(patterns, part):
        out = out.unionByName(texts.mapInArrow(_totals(p, True), shape))
    return out.groupBy("pattern").agg(F.sum("n_rows").alias("n_rows"), F.min("first_id").alias("first_id"))


def unattested(rows: DataFrame, patterns: DataFrame, part: int = PART) -> DataFrame:
    """The distinct patterns, in lower case, that no row holds."""
    asked = patterns.select(F.lower("pattern").alias("pattern")).where("length(pattern) > 0").distinct()
    return asked.join(counts(rows, patterns, part).select("pattern"), "pattern", "left_anti")
