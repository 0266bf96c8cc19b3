"""A stored trigram index for substring search without regard to case.

A gram is three characters as one number of 63 bits; the last two of a text are filled up with a mark that is no character, so
that each character begins a gram. Rows are dealt into segments by the hash of their id; a block holds a gram's rows in one
segment, as positions in it with a mask of the places, modulo 32, where the gram begins, and a block without a gram the
segment's ids. Blocks lie in folders by gram.

A search folds equal needles and looks up how many rows hold each of their grams. The lists of the ``RAREST`` rarest ones meet
segment by segment: a row is left if the masks, turned back by the grams' offsets in the needle, agree on a place. What is left
is verified in the texts, each text once for all its needles. Needles go in slices, so that a task holds the lists of one
segment and the grams of one slice. Needles of one or two characters are the heads of grams, so the index answers them alone.

A gram's rows bound a needle's candidates. The index answers the needles of the fewest candidates, up to ``CANDIDATES`` a row of the
table and ``SLICE`` needles; many or frequent needles beyond that would cost the product of needles and rows, so an automaton
of them reads each text once (``patterns``). Both ways are exact. ``counts`` adds up in the tasks, so no pair of a needle and a row
that the automaton finds leaves its task.

Defined results: null and empty needles find nothing, rows with a null text or id are found by nothing; rows that repeat an
id are candidates together and verified one by one; an empty table gives an empty index. Texts and needles are compared in
lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import patterns
from lodestone.operators.stages import stored

#: Rows and bytes of text in one segment on average, folders of the index, lists of a needle that meet, needles of one slice.
SEGMENT, SEGMENT_BYTES, BUCKETS, RAREST, SLICE = 4096, 32 << 20, 64, 8, 20_000
#: Candidates that a search takes from the index, by the rows of the index.
CANDIDATES = 2
#: A side of no more rows than this goes to every task.
FEW = 100_000
FILL, IDS = 0x1FFFFF, -1


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """The gram that begins at each character of ``text``."""
    x = np.concatenate([_characters(text), [FILL, FILL]])
    return x[:-2] << 42 | x[1:-1] << 21 | x[2:]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _masked(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a text and the places modulo 32 at which each begins."""
    keys = grams(text)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _firsts(keys)
    return keys[first], np.bitwise_or.reduceat(np.uint32(1) << (order % 32).astype(np.uint32), first)


def _blocks(group: pa.Table) -> pa.Table:
    """The blocks of one segment (segment, id, text): the ids, and for each gram the rows that hold it."""
    group = group.sort_by([("id", "ascending"), ("text", "ascending")])  # a repeated task gives the same positions
    found = [_masked(t) for t in group.column("text").to_pylist()]
    rows = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
    keys, masks = np.concatenate([k for k, _ in found]), np.concatenate([m for _, m in found])
    order = np.argsort(keys, kind="stable")
    keys, rows, masks = keys[order], rows[order], masks[order].view(np.int32)
    first = _firsts(keys)
    bounds, n = np.append(first, len(keys)), len(first) + 1
    ids, ends = group.column("id").combine_chunks(), pa.array(np.append(bounds, len(keys)), pa.int32())
    return pa.table({
        "gram": pa.array(np.append(keys[first], IDS), pa.int64()),
        "segment": pa.array(np.full(n, group.column("segment")[0].as_py()), pa.int32()),
        "n": pa.array(np.append(np.diff(bounds), len(found)), pa.int32()),
        "positions": pa.ListArray.from_arrays(ends, pa.array(rows, pa.int16())),
        "masks": pa.ListArray.from_arrays(ends, pa.array(masks, pa.int32())),
        "ids": pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n, np.int32), len(ids)), pa.int32()), ids),
    })


def _needle_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(needle, gram, place) of needles of three characters or more: each gram where it first begins."""
    for b in batches:
        found = [np.unique(grams(n)[:-2], return_index=True) for n in b.column(0).to_pylist()]
        told = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
        joined = [np.concatenate([*(x[i] for x in found), np.zeros(0, np.int64)]) for i in (0, 1)]
        yield pa.record_batch([b.column(0).take(pa.array(told, pa.int64())), pa.array(joined[0], pa.int64()), pa.array(joined[1] % 32, pa.int32())], ["needle", "gram", "place"])


def _meet(needles: list[tuple[str, list[tuple[int, int]]]]):
    """The rows of a segment's lists that may hold the needles, each with its grams and their places."""

    def work(group: pa.Table) -> pa.Table:
        size = max(group.column("n").to_pylist(), default=0)
        lists = {g: i for i, g in enumerate(group.column("gram").to_pylist())}
        positions, masks = group.column("positions").combine_chunks(), group.column("masks").combine_chunks()
        most = int(np.max(positions.flatten().to_numpy(), initial=-1)) + 1 if size else 0
        told, out = [], []
        for i, (_, chosen) in enumerate(needles):
            if any(g not in lists for g, _ in chosen):
                continue
            left = np.full(most, 0xFFFFFFFF, np.uint32)
            for g, place in chosen:
                at = lists[g]
                turned, dense = masks[at].values.to_numpy().view(np.uint32), np.zeros(most, np.uint32)
                dense[positions[at].values.to_numpy()] = turned >> np.uint32(place) | turned << np.uint32((32 - place) % 32) if place else turned
                left &= dense
            if len(hit := np.flatnonzero(left)):
                told.append(np.full(len(hit), i))
                out.append(hit)
        which, hits = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (told, out))
        names = pa.array([n for n, _ in needles], pa.string())
        return pa.table({"needle": names.take(pa.array(which, pa.int64())), "segment": pa.array(np.full(len(hits), group.column("segment")[0].as_py()), pa.int32()), "position": pa.array(hits, pa.int32())})

    return work


def _bucket(gram: Column) -> Column:
    return F.when(gram == IDS, IDS).otherwise(F.pmod(F.xxhash64(gram), F.lit(BUCKETS))).cast("int")


def _few(df: DataFrame) -> DataFrame:
    """A stored side, marked for broadcast if its rows are few."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.blocks = spark.read.schema(f"gram bigint, segment int, n int, positions array<smallint>, masks array<int>, ids array<{id_type}>, bucket int").parquet(path)
        self.lists, self.ids = self.blocks.where(F.col("bucket") != IDS), self.blocks.where(F.col("bucket") == IDS).select("segment", "ids")

    def _chosen(self, folded: DataFrame) -> DataFrame:
        """(needle, grams, least) of needles of three characters or more whose grams all have rows: the rarest grams, and the rows of the rarest one."""
        wanted = stored(folded.where(F.length("needle") > 2).mapInArrow(_needle_grams, "needle string, gram long, place int"))
        keys = _few(stored(wanted.select("gram").distinct().withColumn("bucket", _bucket(F.col("gram")))))
        held = self.lists.select("gram", "bucket", "n").join(keys, ["gram", "bucket"]).groupBy("gram").agg(F.sum("n").alias("rows"))
        each = Window.partitionBy("needle")
        ranked = wanted.join(held, "gram", "left").withColumns({"n": F.row_number().over(each.orderBy(F.col("rows").asc_nulls_first(), "gram")), "all": F.count("rows").over(each) == F.count(F.lit(1)).over(each)})
        return stored(ranked.where(F.col("all") & (F.col("n") <= RAREST)).groupBy("needle").agg(F.collect_list(F.struct("gram", "place")).alias("grams"), F.min("rows").alias("least")))

    def _split(self, chosen: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The needles that the index answers, and those beyond its bounds, if there are any; they part at a power of two of candidates."""
        power = F.floor(F.log2("least")).cast("int")
        most = CANDIDATES * (self.blocks.where(F.col("bucket") == IDS).agg(F.sum("n")).first()[0] or 0)
        pairs = needles = 0
        for r in chosen.groupBy(power.alias("power")).agg(F.sum("least").alias("pairs"), F.count(F.lit(1)).alias("needles")).orderBy("power").collect():  # a row per power
            pairs, needles = pairs + r.pairs, needles + r.needles
            if pairs > most or needles > SLICE:
                return chosen.where(power < r.power), chosen.where(power >= r.power).select("needle")
        return chosen, None

    def _long(self, chosen: DataFrame) -> DataFrame:
        """(needle, segment, position) of rows that may hold the chosen needles."""
        shape = "needle string, segment int, position int"
        out = chosen.sparkSession.createDataFrame([], shape)
        slices = -(-chosen.count() // SLICE)
        for i in range(slices):
            part = chosen.where(F.pmod(F.xxhash64("needle"), F.lit(slices)) == i)
            asked = [(r.needle, [(x.gram, x.place) for x in r.grams]) for r in part.collect()]
            keys = _few(stored(part.select(F.explode("grams.gram").alias("gram")).distinct().withColumn("bucket", _bucket(F.col("gram")))))
            lists = self.lists.select("gram", "bucket", "segment", "n", "positions", "masks").join(keys, ["gram", "bucket"]).drop("bucket")
            out = out.unionByName(lists.groupBy("segment").applyInArrow(_meet(asked), shape))
        return out

    def _short(self, needles: DataFrame) -> DataFrame:
        """(needle, segment, position) of needles of one or two characters."""
        heads = needles.where(F.length("needle").between(1, 2)).mapInArrow(_heads, "needle string, head long, size int")
        one = lambda size, shift: self.lists.withColumn("head", F.shiftright("gram", shift)).join(_few(stored(heads.where(F.col("size") == size))), "head").select("needle", "segment", "positions")
        met = one(1, 42).unionByName(one(2, 21)).groupBy("needle", "segment").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))
        return met.select("needle", "segment", F.explode(F.col("positions").cast("array<int>")).alias("position"))

    def _found(self, chosen: DataFrame, folded: DataFrame) -> DataFrame:
        """Distinct (needle, id) that may match, of the chosen needles and the short ones."""
        found = self._long(chosen).unionByName(self._short(folded)).groupBy("needle", "segment").agg(F.collect_list("position").alias("positions"))
        return found.join(self.ids, "segment").select("needle", F.explode(F.transform("positions", lambda p: F.get("ids", p))).alias("id")).distinct()

    def candidates(self, needles: DataFrame) -> DataFrame:
        """Distinct (needle, id) that may match; ``needles`` has a column ``needle``. Exact for needles of up to three characters."""
        folded = _folded(needles)
        return self._found(self._chosen(folded), folded)

    def _answered(self, needles: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(needle, id) that the index finds in the rows, and the needles for the automaton, as patterns."""
        folded = _folded(needles)
        looked, scanned = self._split(self._chosen(folded))
        by_row = stored(self._found(looked, folded).groupBy("id").agg(F.collect_list("needle").alias("needles")))
        met = rows.select("id", F.lower("text").alias("text")).join(_few(by_row), "id")
        found = met.select("id", "needles", "text").mapInArrow(_verified, f"needle string, id {dict(rows.dtypes)['id']}")
        return found, None if scanned is None else scanned.withColumnRenamed("needle", "pattern")

    def search(self, needles: DataFrame, rows: DataFrame) -> DataFrame:
        """(needle, id) of the rows (id, text) that hold a needle, which is told in lower case."""
        found, scanned = self._answered(needles, rows)
        if scanned is None:
            return found
        return found.unionByName(patterns.holders(rows.where("id is not null"), scanned).withColumnRenamed("pattern", "needle"))

    def counts(self, needles: DataFrame, rows: DataFrame) -> DataFrame:
        """(needle, n_rows, first_id): how many of the rows (id, text) hold a needle, which is told in lower case, and the least id of them."""
        found, scanned = self._answered(needles, rows)
        told = found.groupBy("needle").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"))
        if scanned is None:
            return told
        return told.unionByName(patterns.tallies(rows.where("id is not null"), scanned).withColumnRenamed("pattern", "needle"))


def _folded(needles: DataFrame) -> DataFrame:
    return stored(needles.select(F.lower("needle").alias("needle")).where("length(needle) > 0").distinct())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(needle, id) of the needles that lie in their row's text; Python's search skips ahead, where a column expression tries each byte."""
    for b in batches:
        told, rows = [], []
        for i, (needles, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            held = [n for n in needles if n in t]
            told += held
            rows += [i] * len(held)
        yield pa.record_batch([pa.array(told, pa.string()), b.column(0).take(pa.array(rows, pa.int64()))], ["needle", "id"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        told = [_characters(n) for n in b.column(0).to_pylist()]
        head = [int(x[0]) if len(x) == 1 else int(x[0] << 21 | x[1]) for x in told]
        yield pa.record_batch([b.column(0), pa.array(head, pa.int64()), pa.array([len(x) for x in told], pa.int32())], ["needle", "head", "size"])


def build(rows: DataFrame, path: str) -> TrigramIndex:
    """Write the index of ``rows`` (id, text) and open it; a path that is taken is refused."""
    kind = dict(rows.dtypes)["id"]
    known = rows.select("id", F.lower("text").alias("text")).where("id is not null and length(text) > 0")
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    segments = max(1, -(-n // SEGMENT), -(-size // SEGMENT_BYTES))
    dealt = known.select(F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int").alias("segment"), "id", "text")
    blocks = dealt.groupBy("segment").applyInArrow(_blocks, f"gram long, segment int, n int, positions array<smallint>, masks array<int>, ids array<{kind}>")
    placed = blocks.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.shiftright("segment", 8)).sortWithinPartitions("bucket", "gram", "segment")
    placed.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return TrigramIndex(rows.sparkSession, path, kind)
