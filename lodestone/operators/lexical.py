"""The weighted text index of files and symbols, cover-density scores, and stored postings with block bounds.

A file's index has four parts, one behind the other: its name and path as they are (weight A), the same with camel words
apart and its spine, as English stems without stop words (A), the spine as it is (B), the summary as English stems (C). The
score of a query is 1.5 * density(all words as they are) + 1.25 * density(all stems) + density(any stem).

Density is the cover density of Clarke, Cormack and Tudhope: each shortest run of places that holds all words adds the harmonic
mean of its weights, divided by one more than the number of other places in it; of any word, each place adds its weight. A run
is shortest if its first word does not come again in it, so covers come from windows over a row's places, in the JVM.

``build`` writes the places once, as blocks: a word's postings in one segment of the rows, with the most that any of them can
add to a score. ``TextIndex.top`` reads the bounds of its words' blocks, scores the segments that promise most, and of the
others only those whose bound reaches the kth best score found; a word in every row has a block per segment, never one list.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.stemming import lexeme, lexemes
from lodestone.functions.text import FILLERS, MAX_QUERY_TERMS, QUERY_STOPWORDS, py_split_camel
from lodestone.operators.stages import stored

#: Weights of the index parts, and of the three densities.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
SIMPLE_ALL, STEMMED_ALL, STEMMED_ANY = 1.5, 1.25, 1.0
#: Rows of one segment on average, folders of the stored index, segments that a search scores first, segments that go to every task.
SEGMENT, BUCKETS, PROBE, FEW = 1024, 64, 4, 100_000
INDEXED = ("file_name", "file_path", "symbol_spine", "summary")

_WORD = re.compile(r"[a-z0-9]+")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _told(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def _placed(found: Column, offset: Column, weight: str) -> Column:
    return F.transform(found, lambda w, i: F.struct(w.alias("word"), (offset + i + 1).cast("int").alias("place"), F.lit(WEIGHTS[weight]).alias("weight")))


def places(blobs: DataFrame) -> DataFrame:
    """(id, word, place, weight) of the files' text index."""
    apart = F.translate(F.regexp_replace(_told("file_name", "file_path", "symbol_spine"), "([a-z0-9])([A-Z])", "$1 $2"), "_/.-", "    ")
    cut = blobs.select("id", words(_told("file_name", "file_path")).alias("a"), lexemes(words(apart)).alias("b"), words(_told("symbol_spine")).alias("c"), lexemes(words(_told("summary"))).alias("d"))
    size = lambda *cs: sum((F.size(c) for c in cs), F.lit(0))
    parts = F.concat(_placed(F.col("a"), F.lit(0), "A"), _placed(F.col("b"), size("a"), "A"), _placed(F.col("c"), size("a", "b"), "B"), _placed(F.col("d"), size("a", "b", "c"), "C"))
    return cut.select("id", F.explode(parts).alias("x")).select("id", "x.*").where("word is not null")


def index_of_symbols(symbols: DataFrame) -> DataFrame:
    """(id, word, place, weight) of the text index of symbols: name, signature and content as they are, all of the least weight."""
    return symbols.select("id", F.explode(_placed(words(_told("symbol_name", "signature", "content")), F.lit(0), "D")).alias("x")).select("id", "x.*")


def any_terms(query: str) -> list[str]:
    """At most twelve words for the any-word part: no stop words unless there is nothing else."""
    told = [w for w in dict.fromkeys(_WORD.findall(py_split_camel(query).lower())) if len(w) >= 2 and w not in FILLERS]
    return ([w for w in told if w not in QUERY_STOPWORDS] or told)[:MAX_QUERY_TERMS]


@dataclass
class Asked:
    """What a query asks for: sets of words of which all must be there, by the weight of their density, and words of which any may."""

    all: list[tuple[float, tuple[str, ...]]]
    any: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return sorted({w for _, ws in self.all for w in ws} | set(self.any))


def asked(query: str) -> Asked:
    """The three parts of a file search."""
    plain = tuple(sorted(set(_WORD.findall(query.lower()))))
    stems = tuple(sorted({s for w in plain if (s := lexeme(w))}))
    loose = tuple(sorted({s for w in any_terms(query) if (s := lexeme(w))}))
    return Asked([(k, ws) for k, ws in ((SIMPLE_ALL, plain), (STEMMED_ALL, stems)) if ws], loose)


def symbols_asked(query: str) -> Asked:
    """All words as they are."""
    plain = tuple(sorted(set(_WORD.findall(query.lower()))))
    return Asked([(1.0, plain)] if plain else [], ())


def _covers(n: int, ws: tuple[str, ...], hits: DataFrame) -> DataFrame:
    """``hits`` with column cover{n}: what the shortest run of all ``ws`` that begins at a place adds; null if none does."""
    upto = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("id").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    one = F.col("word").isin(*ws)
    here = F.when(one, F.struct("place", F.col(f"cost{n}").alias("cost"), F.col(f"count{n}").alias("count")))
    hits = hits.withColumns({f"cost{n}": F.sum(F.when(one, 1 / F.col("weight"))).over(upto), f"count{n}": F.count(F.when(one, 1)).over(upto)})
    hits = hits.withColumns({f"next{n}_{i}": F.min(F.when(F.col("word") == w, here)).over(behind) for i, w in enumerate(ws)})
    again = F.coalesce(*[F.when(F.col("word") == w, F.col(f"next{n}_{i}")) for i, w in enumerate(ws)])
    ends = [F.when(F.col("word") == w, here).otherwise(F.col(f"next{n}_{i}")) for i, w in enumerate(ws)]
    whole = one
    for e in ends:
        whole = whole & e.isNotNull()
    end = F.greatest(*ends) if len(ends) > 1 else ends[0]
    held = end["count"] - F.col(f"count{n}") + 1
    noise = end["place"] - F.col("place") - (held - 1)
    cover = held / (end["cost"] - F.col(f"cost{n}") + 1 / F.col("weight")) / (1 + noise)
    return hits.withColumn(f"cover{n}", F.when(whole & (again.isNull() | (again["place"] > end["place"])), cover)).drop(*[f"next{n}_{i}" for i in range(len(ws))], f"cost{n}", f"count{n}")


def score_hits(hits: DataFrame, q: Asked) -> DataFrame:
    """(id, score) of rows whose places (id, word, place, weight) answer the query: one shuffle by id, one sort."""
    hits = hits.where(F.col("word").isin(*q.words)) if q.words else hits.limit(0)
    for n, (_, ws) in enumerate(q.all):
        hits = _covers(n, ws, hits)
    parts = [k * F.coalesce(F.sum(f"cover{n}"), F.lit(0.0)) for n, (k, _) in enumerate(q.all)]
    parts += [STEMMED_ANY * F.coalesce(F.sum(F.when(F.col("word").isin(*q.any), F.col("weight"))), F.lit(0.0))] if q.any else []
    return hits.groupBy("id").agg(sum(parts, F.lit(0.0)).alias("score")).where("score > 0")


def _near(query: str) -> Column:
    """Rows that may match, by the first letters that a word shares with its stem: a substring test ahead of the stems."""
    found = _told(*INDEXED)
    heads = {w[: max(1, len(w) - 3)] for w in asked(query).words}
    return F.greatest(*[F.contains(F.lower(found), F.lit(h)) for h in sorted(heads)], F.lit(False)) if heads else F.lit(False)


def scores(blobs: DataFrame, query: str) -> DataFrame:
    """(id, score) of the files that match, without a stored index."""
    return score_hits(places(blobs.where(_near(query))), asked(query))


class TextIndex:
    """A stored index: blocks by word and segment."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        postings = f"array<struct<id:{id_type},places:array<struct<place:int,weight:double>>>>"
        self.blocks = spark.read.schema(f"word string, segment int, postings {postings}, most_weight double, most_places int, heaviest double, bucket int").parquet(path)
        #: Segments of the last ``top``: with a bound, scored.
        self.seen: tuple[int, int] = (0, 0)

    def _read(self, found: list[str]) -> DataFrame:
        """The blocks of these words: their folders alone, and in them what the words' range leaves."""
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in found})
        return self.blocks.where(F.col("bucket").isin(buckets) & F.col("word").isin(found))

    def _hits(self, blocks: DataFrame) -> DataFrame:
        rows = blocks.select("word", F.explode("postings").alias("p")).select("word", "p.id", F.explode("p.places").alias("x"))
        return rows.select("id", "word", "x.place", "x.weight")

    def scores(self, query: str | Asked) -> DataFrame:
        """(id, score) of all rows that match."""
        q = asked(query) if isinstance(query, str) else query
        return score_hits(self._hits(self._read(q.words) if q.words else self.blocks.limit(0)), q)

    def top(self, query: str | Asked, k: int) -> DataFrame:
        """(id, score) of the ``k`` best rows (of equal scores the least id), without scoring segments that cannot hold one."""
        q = asked(query) if isinstance(query, str) else query
        if not q.words:
            return self.scores(q).limit(0)
        blocks = self._read(q.words)
        bound = F.lit(0.0)
        if q.any:
            bound = bound + STEMMED_ANY * F.coalesce(F.sum(F.when(F.col("word").isin(*q.any), F.col("most_weight"))), F.lit(0.0))
        for factor, ws in q.all:  # a run begins at a hit, and its harmonic mean is at most its largest weight
            one = F.col("word").isin(*ws)
            whole = F.count_distinct(F.when(one, F.col("word"))) == len(ws)
            bound = bound + F.when(whole, factor * F.sum(F.when(one, F.col("most_places"))) * F.max(F.when(one, F.col("heaviest")))).otherwise(0.0)
        bounds = stored(blocks.groupBy("segment").agg(bound.alias("bound")))
        best = lambda df: df.orderBy(F.desc("score"), "id").limit(k)
        probe = [r.segment for r in bounds.orderBy(F.desc("bound"), "segment").limit(PROBE + math.ceil(2 * k / SEGMENT)).select("segment").collect()]
        known = F.col("segment").isin(probe)
        first = stored(best(score_hits(self._hits(blocks.where(known)), q)))
        n, floor = first.agg(F.count(F.lit(1)), F.min("score")).first()
        reached = ~known & (F.col("bound") >= (floor * (1 - 1e-9) if n == k else 0.0))
        total, left = bounds.agg(F.count(F.lit(1)), F.count_if(reached)).first()
        self.seen = total, len(probe) + left
        if not left:
            return first
        rest = bounds.where(reached).select("segment")
        chosen = F.broadcast(rest) if left <= FEW else rest
        return best(first.unionByName(score_hits(self._hits(blocks.join(chosen, "segment")), q)))


def _bucket() -> Column:
    return (F.crc32(F.encode("word", "UTF-8")) % BUCKETS).cast("int")


def build(spark: SparkSession, found: DataFrame, path: str, rows: int) -> TextIndex:
    """Write the places (id, word, place, weight) of about ``rows`` rows as blocks, and open them."""
    segments = max(1, -(-rows // SEGMENT))
    keyed = found.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int")).repartition("word", "segment")
    postings = keyed.groupBy("word", "segment", "id").agg(F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("places"), F.sum("weight").alias("sum"), F.max("weight").alias("heaviest"))
    blocks = postings.groupBy("word", "segment").agg(
        F.collect_list(F.struct("id", "places")).alias("postings"), F.max("sum").alias("most_weight"), F.max(F.size("places")).alias("most_places"), F.max("heaviest").alias("heaviest")
    )
    dealt = blocks.withColumn("bucket", _bucket()).repartitionByRange("bucket", "word", "segment").sortWithinPartitions("bucket", "word", "segment")
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return TextIndex(spark, path, dict(found.dtypes)["id"])
