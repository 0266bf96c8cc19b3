"""Language-model scores: prediction by partial matching (PPM) over bytes, beside a smoothed word unigram.

PPM. The model holds the counts of every byte context up to ``ORDER`` bytes and of the symbol behind it, over all training
texts (A-Z lower-cased, ``ORDER`` start marks in front, one end mark behind, so there are 257 symbols), as a written table
of grams that grows with the corpus. A symbol's probability starts in the longest context. Where it was not seen there,
the escape (method C: the number of distinct symbols over that number plus their counts) leads to the next shorter context,
from which all symbols of the longer one are excluded; the last resort is uniform over what remains. Grams meet by the last
three symbols of their context, hashed to ``BUCKETS`` groups: longer contexts lie in one group, and the counts of the
shorter ones (at most 257^3) are sent to every worker. A chunk asks for its distinct grams once. What is asked of a group grows
with the corpus and is cut at ``SLICE_BYTES``; each slice meets a copy of the group's counts, which the alphabet bounds.

Words. Each chunk of a task's texts has a vocabulary of its own, numbered as they come; documents are in a written
table, in compressed runs. Vocabularies, not documents, meet the global word counts, and the counts return to their chunk.

Defined results: a null text counts as empty (one token, the end); a null doc_id counts as the empty string in the split;
repeated rows are rows of their own; an empty table gives an empty result; without training rows the base score is 0 per
token and PPM is uniform; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, raw, runs, small_batches

#: Symbols: the bytes, and 256 for either end of a text.
END, SYMBOLS = 256, 257
#: Bytes of context, bits of a symbol in a gram (context and symbol, the symbol lowest), groups of grams.
ORDER, BITS, BUCKETS = 5, 9, 512
#: Grams that a task holds before it passes them on, or looks up at once.
HELD = 1 << 20
#: Bytes of asked-for grams that one group takes at once, on average.
SLICE_BYTES = 48 << 20
#: Bytes of text in a chunk; a chunk's vocabulary and documents are one task's work.
CHUNK_BYTES = 12 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trie places (two symbols of context and the symbol) of all texts, end to end, and where each text's begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    a = np.full(int(sizes.sum()) + 2 * len(texts) + 1, END, np.int32)
    own = np.ones(len(a), bool)
    own[starts] = own[starts + 1] = own[-1] = False
    a[own] = np.frombuffer(b"".join(texts), np.uint8)
    out = (a[:-2] * SYMBOLS + a[1:-1]) * SYMBOLS + a[2:]
    told = np.ones(len(out), bool)
    told[starts[1:] - 1] = False  # the second start mark of the next text is not predicted
    return out[told], starts - np.arange(len(texts))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts, end to end, and where each text's begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    a = np.full(int(sizes.sum()) + ORDER * len(texts) + 1, END, np.int64)
    own = np.ones(len(a), bool)
    for i in range(ORDER):
        own[starts + i] = False
    own[-1] = False
    a[own] = np.frombuffer(b"".join(texts), np.uint8)
    n = len(a) - ORDER
    out = np.zeros(n, np.int64)
    for i in range(ORDER + 1):
        out = out << BITS | a[i : n + i]
    told = np.ones(n, bool)
    for i in range(1, ORDER):
        told[starts[1:] - i] = False  # of the next text's start marks only the first, as this one's end, is predicted
    return out[told], starts - (ORDER - 1) * np.arange(len(texts))


def _low(gram: np.ndarray, order: int) -> np.ndarray:
    """The gram with the last ``order`` symbols of its context."""
    return gram & ((1 << BITS * (order + 1)) - 1)


def buckets(gram: np.ndarray) -> np.ndarray:
    context = (_low(gram, 3) >> BITS).astype(np.uint64)
    return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def _added(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and the sums of their counts."""
    found, at = np.unique(gram, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        gram, n = _added(*map(np.concatenate, zip(*held, strict=True)))
        return pa.record_batch([pa.array(buckets(gram).astype(np.int32)), pa.array(gram), pa.array(n)], ["bucket", "gram", "n"])

    for b in batches:
        for part in runs([t.lower() for t in raw(b.column(0))]):
            held.append(np.unique(grams(part)[0], return_counts=True))
            size += len(held[-1][0])
            if size > 4 * HELD:
                held = [_added(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > 2 * HELD:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def table(place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each trie place: [two symbols of context, symbol], flattened."""
    order = np.argsort(place)
    place, n = place[order], n[order].astype(np.float64)
    first = np.searchsorted(place, np.arange(SYMBOLS + 1) * SYMBOLS**2)
    n1 = np.bincount(place % SYMBOLS**2, n, SYMBOLS**2).reshape(SYMBOLS, SYMBOLS)
    n0 = n1.sum(axis=0)
    left = SYMBOLS - int((n0 > 0).sum())
    uniform = 1 / left if left else 0.0

    def level(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Counts without the excluded symbols against the next level; a context without any passes all on."""
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        escape = np.where(kinds > 0, kinds / whole, 1.0)
        return np.where(counts > 0, counts / whole, escape * lower)

    p0 = level(np.where(n1 > 0, 0, n0), np.full((SYMBOLS, SYMBOLS), uniform))  # for each symbol of context, after its escape
    out = np.empty((SYMBOLS, SYMBOLS, SYMBOLS), np.float32)
    for a in range(SYMBOLS):
        i, j = first[a], first[a + 1]
        n2 = np.bincount(place[i:j] - a * SYMBOLS**2, n[i:j], SYMBOLS**2).reshape(SYMBOLS, SYMBOLS)
        out[a] = np.log10(np.maximum(level(n2, level(np.where(n2 > 0, 0, n1), p0)), 1e-300))
    return out.ravel()


class Trie:
    """A model of two bytes of context as one dense table, against which short orders can be checked."""

    def __init__(self, place: np.ndarray, n: np.ndarray):
        self.place, self.n = place, n

    @functools.cached_property
    def log10(self) -> np.ndarray:
        return table(self.place, self.n)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        parts = [np.add.reduceat(self.log10[at], starts, dtype=np.float64) for at, starts in map(places, runs([t.lower() for t in texts]))]
        return np.concatenate(parts) if parts else np.zeros(0)


class Level:
    """The counts of one order: grams, their counts, and of each context how many symbols and occurrences it has."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, lower: Level | None):
        self.gram, self.n, self.order = gram, n, 0 if lower is None else lower.order + 1
        self.context, at = np.unique(gram >> BITS, return_inverse=True)
        self.kinds, self.total = np.bincount(at, minlength=len(self.context)), np.bincount(at, n, len(self.context))
        if lower is not None and len(gram):  # what the next shorter context keeps once the symbols seen here are excluded
            mask = (1 << BITS * lower.order) - 1
            under = np.searchsorted(lower.context, self.context & mask)
            own = lower.n[np.searchsorted(lower.gram, gram & ((1 << BITS * (lower.order + 1)) - 1))]
            self.left_total = lower.total[under] - np.bincount(at, own, len(self.context))
            self.left_kinds = lower.kinds[under] - self.kinds
        else:
            self.left_total = self.left_kinds = np.zeros(len(self.context))


def levels(gram: np.ndarray, n: np.ndarray, orders: range, lower: Level | None = None) -> list[Level]:
    """The levels of ``orders`` (ascending) above ``lower``, from counted grams."""
    out = []
    for k in orders:
        lower = Level(*_added(_low(gram, k), n), lower)
        out.append(lower)
    return out


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x is in the sorted keys, and whether it is there at all."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def log10_of(asked: np.ndarray, ladder: list[Level]) -> np.ndarray:
    """log10 probability of each gram's symbol behind its context; ``ladder``: the levels from order 0 up."""
    p, open_ = np.ones(len(asked)), np.ones(len(asked), bool)
    above, was = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    for k in range(len(ladder) - 1, -1, -1):
        x, key = ladder[k], _low(asked, k)
        at, seen = _find(x.gram, key)
        context, met = _find(x.context, key >> BITS)
        total, kinds = np.zeros(len(asked)), np.zeros(len(asked))
        total[met], kinds[met] = x.total[context[met]], x.kinds[context[met]]
        if was.any():
            total[was], kinds[was] = ladder[k + 1].left_total[above[was]], ladder[k + 1].left_kinds[above[was]]
        hit, miss = open_ & seen, open_ & ~seen & (kinds > 0)
        p[hit] *= x.n[at[hit]] / (total[hit] + kinds[hit])
        p[miss] *= kinds[miss] / (total[miss] + kinds[miss])
        open_ &= ~seen
        above, was = context, met
    p[open_] /= SYMBOLS - len(ladder[0].gram)
    return np.log10(np.maximum(p, 1e-300)).astype(np.float32)


class Short:
    """The counts of the contexts up to two bytes, as sent to the workers; each worker makes the levels once."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, self.n = gram, n

    @functools.cached_property
    def ladder(self) -> list[Level]:
        return levels(self.gram, self.n, range(3))


def fit(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Short]:
    """The counted grams (bucket, gram, n) of all texts in ``docs``, as a written table, and the short contexts."""
    small_batches(spark)
    counted = docs.select("text").mapInArrow(_counted, "bucket int, gram long, n long")
    found = scratch.save(counted.groupBy("bucket", "gram").agg(F.sum("n").alias("n")), "grams")
    rows = found.groupBy(F.col("gram").bitwiseAND((1 << 3 * BITS) - 1).alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    return found, Short(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def answered(asked: DataFrame, counted: DataFrame, short: Short) -> DataFrame:
    """(part, bucket, logs): the log10 probabilities of the grams that ``asked`` (chunk, bucket, grams) holds, in their order."""
    shared = asked.sparkSession.sparkContext.broadcast(short)

    def run(asked: pa.Table, counted: pa.Table) -> pa.Table:
        low = shared.value.ladder
        ladder = low + levels(counted.column("gram").to_numpy(), counted.column("n").to_numpy(), range(3, ORDER + 1), low[-1])
        lists, logs = asked.column("grams").to_pylist(), []
        for part in runs(lists, 8 * HELD):
            x, at = np.unique(np.frombuffer(b"".join(part), np.int64), return_inverse=True)
            y = log10_of(x, ladder)[at]
            logs += [z.tobytes() for z in np.split(y, np.cumsum([len(g) // 8 for g in part])[:-1])]
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(logs, pa.binary())], ["part", "bucket", "logs"])

    held = dict(asked.groupBy("bucket").agg(F.sum(F.octet_length("grams"))).collect())  # at most BUCKETS rows
    slices = F.element_at(F.array(*[F.lit(1 + (held.get(b) or 0) // SLICE_BYTES) for b in range(BUCKETS)]), F.col("bucket") + 1)
    dealt = asked.withColumn("slice", F.pmod(F.xxhash64("chunk"), slices.cast("long")).cast("int"))
    copied = counted.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return dealt.groupBy("bucket", "slice").cogroup(copied.groupBy("bucket", "slice")).applyInArrow(run, "part long, bucket int, logs binary")


_CHUNKS = "chunk long, at int, ids array<long>, held array<boolean>, sizes array<int>, texts binary, word binary, number int, n long, bucket int, grams binary"


def _ordered(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct, sorted grams by bucket, and their buckets in that order."""
    place = buckets(found)
    order = np.argsort(place, kind="stable")
    return order, place[order]


def chunked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of three kinds: runs of documents (at, ids, held, sizes, texts, n: training documents), vocabulary (word, number, n: training occurrences), grams asked for (bucket, grams)."""
    small_batches(spark)
    names, kinds = zip(*[x.split() for x in _CHUNKS.split(", ")], strict=True)
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}
    arrow |= {f"array<{k}>": pa.list_(v) for k, v in arrow.items()}

    def rows(chunk: int, size: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = pa.array(np.full(size, chunk))
        return pa.record_batch([columns.get(c, pa.nulls(size, arrow[k])) for c, k in zip(names, kinds, strict=True)], list(names))

    def run(batches):
        part, seq, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor()
        numbers: dict[bytes, int] = {}
        counts, asked, held, at = [], [], 0, 0

        def close():
            total = np.zeros(len(numbers), np.int64)
            for ids in counts:
                total += np.bincount(ids, minlength=len(numbers))
            words, chunk = list(numbers), part << 24 | seq
            for i in range(0, len(words), 50_000):
                w = words[i : i + 50_000]
                yield rows(chunk, len(w), word=pa.array(w, pa.binary()), number=pa.array(np.arange(i, i + len(w), dtype=np.int32)), n=pa.array(total[i : i + len(w)]))
            found = np.unique(np.concatenate([np.zeros(0, np.int64), *asked]))
            order, place = _ordered(found)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            if len(first):
                yield rows(chunk, len(first), bucket=pa.array(place[first].astype(np.int32)), grams=pa.array([x.tobytes() for x in np.split(found[order], first[1:])], pa.binary()))

        for b in batches:
            texts, ids, out = [t.lower() for t in raw(b.column(1))], b.column(0).to_pylist(), b.column(2).to_pylist()
            for t, o in zip(texts, out, strict=True):
                x = np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], np.uint32)
                if not o:
                    counts.append(x)
                held += len(t)
            first = 0
            for some in runs(texts):
                asked.append(pd.unique(grams(some)[0]))
                own = slice(first, first + len(some))
                told = {"ids": ids[own], "held": out[own], "sizes": [len(t) for t in some], "texts": pack.compress(b"".join(some)), "n": out[own].count(False), "at": at + first}
                yield rows(part << 24 | seq, 1, **{c: pa.array([v], arrow[kinds[names.index(c)]]) for c, v in told.items()})
                first += len(some)
            counts, at = [np.concatenate(counts)] if counts else [], at + len(texts)
            if held >= CHUNK_BYTES:
                yield from close()
                numbers, counts, asked, held, at, seq = {}, [], [], 0, 0, seq + 1
        yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")).mapInArrow(run, _CHUNKS)


def ppm(texts: list[bytes], logs: list[bytes]) -> np.ndarray:
    """log10 probability of each lower-cased text of a chunk from the answers to its grams, by bucket."""
    told = []
    for some in runs(texts):
        gram, starts = grams(some)
        codes, own = pd.factorize(gram)
        told.append((codes.astype(np.int32), own, starts))
    found = np.unique(np.concatenate([np.zeros(0, np.int64), *[own for _, own, _ in told]]))
    value = np.empty(len(found), np.float32)
    value[_ordered(found)[0]] = np.frombuffer(b"".join(logs), np.float32)
    parts = [np.add.reduceat(value[np.searchsorted(found, own)][codes], starts, dtype=np.float64) for codes, own, starts in told]
    return np.concatenate(parts) if parts else np.zeros(0)


def _score(train_tokens: int, kinds: int, ends: int):
    size = train_tokens + kinds + 1

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs = docs.sort_by("at")  # so that the words get the numbers that they had
        texts = []
        for packed, sizes in zip(docs.column("texts").to_pylist(), docs.column("sizes").to_pylist(), strict=True):
            joined = zstandard.ZstdDecompressor().decompress(packed)
            texts += [joined[z - n : z] for n, z in zip(sizes, np.cumsum(sizes).tolist(), strict=True)]
        logs = told.filter(pc.is_valid(told.column("logs"))).sort_by("bucket").column("logs").to_pylist()
        words = told.filter(pc.is_valid(told.column("number")))
        score = ppm(texts, logs)
        numbers: dict[bytes, int] = {}
        lists = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], np.uint32) for t in texts]
        c = np.zeros(len(numbers), np.int64)  # words unseen in training have no row
        c[words.column("number").to_numpy()] = words.column("c").to_numpy()
        log = np.log10((c + 1) / size)
        out = []
        for ids in lists:
            out.append((len(ids) + 1, int((c[ids] > 0).sum()) + (ends > 0), float(log[ids].sum() + np.log10((ends + 1) / size))))
        n, known, base = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pc.list_flatten(docs.column("ids")), pc.list_flatten(docs.column("held")), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([train_tokens] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(spark, "lm")
    counted, short = fit(spark, docs.where(~held_out()), scratch)
    rows = scratch.save(chunked(spark, docs), "chunks")
    words, texts = rows.where("word is not null"), rows.where("texts is not null")
    counts = scratch.save(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    kinds, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    logs = scratch.save(answered(rows.where("grams is not null").select("chunk", "bucket", "grams"), counted, short), "logs")
    known = words.select(F.col("chunk").alias("part"), "word", "number").join(counts, "word").select("part", "number", "c")
    told = known.unionByName(logs, allowMissingColumns=True)
    run = _score(total + ends, kinds + (ends > 0), ends)
    tasks = max(1, texts.select("chunk").distinct().count())  # a chunk each, whatever the session's setting
    return (
        texts.select("chunk", "at", "ids", "held", "sizes", "texts").repartition(tasks, "chunk").groupBy("chunk").cogroup(told.repartition(tasks, "part").groupBy("part"))
        .applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
