"""Alignment of two tokenizers' ids over the same bytes, by a dangling-suffix transducer.

The transducer reads two streams of tokens. Its state is the side that leads and the bytes by which it leads, always the
dangling suffix of that side's last token; the lagging side moves next. A move links the leader's last token with the token
just read, and an empty suffix closes the group. Transitions depend on the suffix and the token alone and are remembered.

A text goes through it in units: cuts fall at single blanks between two characters that are no white space, where both
tokenizers begin a token (A's pattern breaks there, and no piece of B has a blank behind another character), so both streams
are level. Units are remembered with their ids, groups and links; a text's results are sums and joins over its units.

The links of each document are written as distinct id pairs with their numbers. Pairs are counted per task, then per corpus;
the table of pairs is as large as the vocabularies allow, goes to every task only when measured to be small, and is shuffled
with its hot keys apart otherwise.

Defined results: texts that are null, empty, or that one of the sides cannot render byte by byte (as where a text holds the
blank sign of B) have no tokens, zero counts and an empty digest; strings of special tokens are plain text; rows that repeat an id or text are
documents of their own and count as such; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, bounded, hot_keys, join_hot, raw, runs, small_batches
from lodestone.llm.tokens import _Numbers, ragged, slices

#: Units, and bytes that stand for them, that a worker remembers; beyond it all are forgotten. States of the transducer likewise.
KNOWN_UNITS, KNOWN_CHARS, STATES = 400_000, 96 << 20, 1 << 20
#: Units that are encoded and aligned together; longer ones, and those with white space at an end, go one by one.
TOGETHER, LONG = 4000, 64
#: The table of pairs goes to every task up to this many rows and bytes; pairs that a task counts before it tells.
PAIR_ROWS, PAIR_BYTES, TASK_PAIRS = 4_000_000, 256 << 20, 2_000_000
#: A pair is one number, id of A times this plus id of B.
B_IDS = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Transducer:
    """Aligns two token streams; ``a`` and ``b`` are the bytes of the tokens by id."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = a, b
        self.forget()

    def forget(self) -> None:
        #: States are (leading side, suffix), numbered; 0 is level.
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers = {self.states[0]: 0}
        #: The side that moves next, by state.
        self.next = np.zeros(1, np.int64)
        #: Transitions: (state, token) as one number, in order, and the state behind.
        self.keys, self.targets = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _move(self, state: int, token: int) -> int:
        """The state behind a move of the lagging side (A if level); -1 if the bytes differ."""
        leader, suffix = self.states[state]
        side = 1 - leader if suffix else 0
        new = self.bytes[side][token]
        if not (suffix.startswith(new) or new.startswith(suffix)):
            return -1
        key = (leader, suffix[len(new) :]) if len(new) < len(suffix) else (side, new[len(suffix) :])
        if not key[1]:
            return 0
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key]

    def moved(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The states behind many moves; only transitions not met before are worked out."""
        keys = states << 32 | tokens
        at = np.searchsorted(self.keys, keys)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == keys[old]
        if not old.all():
            new = np.unique(keys[~old])
            targets = np.array([self._move(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int64)
            order = np.argsort(joined := np.concatenate([self.keys, new]))
            self.keys, self.targets = joined[order], np.concatenate([self.targets, targets])[order]
            self.next = np.array([1 - leader if suffix else 0 for leader, suffix in self.states], np.int64)
            at = np.searchsorted(self.keys, keys)
        return self.targets[at]

    def align(self, streams: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Aligns many pairs of streams in step, each side's end to end with the given sizes; each round moves every pair once.

        (whether the bytes agree, links: pair, place in a, place in b, whether it closes a group), links by pair and in order.
        """
        if len(self.states) > STATES:
            self.forget()
        ends = [np.cumsum(n) for n in sizes]
        at = np.stack([e - n for e, n in zip(ends, sizes, strict=True)], 1)
        stop = np.stack(ends, 1)
        good = np.ones(len(at), bool)
        active = np.flatnonzero((at != stop).any(axis=1))
        state = np.zeros(len(at), np.int64)
        links = []
        while len(active):
            now = state[active]
            side = self.next[now]
            place = at[active, side]
            short = place == stop[active, side]  # a side that should move has ended
            if short.any():
                good[active[short]] = False
                active, now, side, place = active[~short], now[~short], side[~short], place[~short]
            a = side == 0
            tokens = np.empty(len(place), np.int64)
            tokens[a], tokens[~a] = streams[0][place[a]], streams[1][place[~a]]
            new = self.moved(now, tokens)
            at[active, side] += 1
            good[active[new < 0]] = False
            told = (now > 0) & (new >= 0)
            links.append((active[told], at[active[told], 0] - 1, at[active[told], 1] - 1, new[told] == 0))
            state[active] = new
            active = active[(new > 0) | (new == 0) & (at[active] != stop[active]).any(axis=1)]
        pair, i, j, closes = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 4
        order = np.argsort(pair, kind="stable")
        order = order[good[pair[order]]]
        return good, pair[order], i[order], j[order], closes[order].astype(bool)


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars, names = byte_level(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.a_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        if len(pieces) > B_IDS:
            raise ValueError("too many pieces")
        #: Whether a blank begins a piece wherever it follows another character.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in self.transducer.bytes]
        names = [[f"{i},".encode() for i in range(len(x))] for x in self.transducer.bytes]
        #: Ids in decimal, each with a byte for what follows it, those of B behind those of A.
        self.digits = np.frombuffer(b"".join(names[0] + names[1]), np.uint8)
        self.lengths = np.array(list(map(len, names[0] + names[1])), np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def units(self, text: str) -> list[str]:
        """The parts of the text; a blank belongs in front of each."""
        return (_CUT.split(text) if self.cuts and text[:1].strip() else [text]) if text else []

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)
        return np.array(a, np.int64), np.array(b, np.int64)

    def _encoded(self, units: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None:
        """Ids of both sides for units side by side, and their numbers by unit; None if a side does not render them."""
        text = " ".join(units)
        whole = b" " + text.encode()
        ends = np.cumsum([len(u.encode()) + 1 for u in units]) if len(units) > 1 else np.array([len(whole)])
        streams, numbers = self._ids(text), []
        for ids, sizes, tokens in zip(streams, self.sizes, self.transducer.bytes, strict=True):
            at = np.cumsum(sizes[ids])
            last = np.searchsorted(at, ends)
            if not len(ids) or last[-1] >= len(ids) or (at[last] != ends).any() or b"".join(map(tokens.__getitem__, ids.tolist())) != whole:
                return None
            numbers.append(np.diff(last, prepend=-1))
        return streams, (numbers[0], numbers[1])

    def _groups(self, streams: tuple[np.ndarray, np.ndarray], numbers: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """Groups as told, by unit; ``ends``: the last token of each group on each side."""
        keys, after = [], []
        for side, (ids, last) in enumerate(zip(streams, ends, strict=True)):
            follows = np.full(len(ids), ord(","), np.uint8)
            follows[last] = ord("|;"[side])
            after.append(follows)
            keys.append(2 * np.searchsorted(last, np.arange(len(ids))) + side)
        order = np.argsort(np.concatenate(keys), kind="stable")
        ids = np.concatenate([streams[0], streams[1] + len(self.a_bytes)])[order]
        lengths = self.lengths[ids]
        text = ragged(self.digits, self.places[ids], lengths)
        stops = np.cumsum(lengths)
        text[stops - 1] = np.concatenate(after)[order]
        line, tokens = text.tobytes(), np.cumsum(numbers[0] + numbers[1])
        cuts = [0, *stops[tokens - 1].tolist()]
        return [line[i : j - 1] for i, j in itertools.pairwise(cuts)]

    def align(self, units: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Per unit: (tokens of A, tokens of B, groups, links; negative if it cannot be aligned), groups as told; links as pairs, end to end.

        More than one unit need to begin and end with what is no white space."""
        found = self._encoded(units)
        if found is not None:
            (a, b), (n_a, n_b) = found
            good, unit, i, j, closes = self.transducer.align((a, b), (n_a, n_b))
        if found is None or not good.all():
            if len(units) == 1:
                return np.full((1, 4), -1, np.int64), [b""], np.zeros(0, np.int64)
            parts = [self.align([u]) for u in units]
            return np.concatenate([x[0] for x in parts]), [g for x in parts for g in x[1]], np.concatenate([x[2] for x in parts])
        last = np.flatnonzero(closes)
        n_links, n_groups = np.bincount(unit, minlength=len(units)), np.bincount(unit[last], minlength=len(units))
        return np.stack([n_a, n_b, n_groups, n_links], 1), self._groups((a, b), (n_a, n_b), (i[last], j[last])), a[i] * B_IDS + b[j]


@functools.lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Known:
    """What is known of the units seen so far."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.groups: list[bytes] = []
        self.counts, self.starts = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)
        self.chars = 0

    def numbered(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all texts' units, end to end; new units are learned."""
        if self.chars > KNOWN_CHARS or len(self.numbers) > KNOWN_UNITS:
            self.clear()
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64)
        new = list(islice(reversed(self.numbers), len(self.numbers) - len(self.groups)))[::-1]
        tidy = [u for u in new if len(u) <= LONG and not u[:1].isspace() and not u[-1:].isspace()]
        if len(tidy) < len(new):  # the others go one by one, behind
            held = set(tidy)
            rest = [u for u in new if u not in held]
            self.numbers.update(zip(tidy + rest, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64)
        else:
            rest = []
        for part in [tidy[k : k + TOGETHER] for k in range(0, len(tidy), TOGETHER)] + [[u] for u in rest]:
            counts, groups, links = self.pair.align(part)
            sizes = np.maximum(counts[:, 3], 0)
            self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(sizes) - sizes])
            self.counts = np.concatenate([self.counts, counts])
            self.links = np.concatenate([self.links, links])
            self.groups += groups
            self.chars += sum(map(len, part)) + sum(map(len, groups)) + 8 * len(links)
        return flat


_known: dict[tuple[str, str], Known] = {}
_DIGESTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def _told(known: Known, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    units = [known.pair.units(t) for t in texts]
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    flat = known.numbered(units)
    doc = np.repeat(np.arange(len(units)), sizes)
    good = np.bincount(doc[known.counts[flat, 0] < 0], minlength=len(units)) == 0
    flat, doc = flat[good[doc]], doc[good[doc]]
    ends = np.searchsorted(doc, np.arange(len(units) + 1))
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(known.counts[flat], axis=0)])
    totals = sums[ends[1:]] - sums[ends[:-1]]
    groups, shas = known.groups, []
    for part in slices(flat, np.diff(ends)):
        shas.append(hashlib.sha256(b";".join([groups[n] for n in part.tolist()])).hexdigest() if len(part) else "")
    # units repeat within a document: each once with its number, then their links, summed over units
    used, unit = np.unique(flat, return_inverse=True)
    n = max(1, len(used))
    key, times = np.unique(doc * n + unit, return_counts=True)
    doc, unit = key // n, used[key % n]
    lengths = known.counts[unit, 3]
    distinct, where = np.unique(ragged(known.links, known.starts[unit], lengths), return_inverse=True)
    key = np.repeat(doc, lengths) * max(1, len(distinct)) + where
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.repeat(times, lengths)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, first) if len(first) else times
    doc, pairs = key[first] // max(1, len(distinct)), distinct[key[first] % max(1, len(distinct))]
    ends = pa.array(np.searchsorted(doc, np.arange(len(units) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, times.astype(np.int32))]
    return pa.record_batch([ids, *(pa.array(totals[:, c]) for c in range(4)), pa.array(shas), *lists], _NAMES)


def _aligner(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.setdefault((a_path, b_path), Known(pair(a_path, b_path)))
        for batch in batches:
            at = 0
            for texts in runs(raw(batch.column(1)), 1 << 20):
                yield _told(known, batch.column(0).slice(at, len(texts)), [t.decode() for t in texts])
                at += len(texts)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the number of their documents, summed over the task as far as memory allows."""
    held, n = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
    for b in batches:
        pairs = np.concatenate([held[0], b.column(0).flatten().to_numpy()])
        counts = np.concatenate([held[1], np.ones(len(pairs) - len(held[0]), np.int64)])
        distinct, where = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, where, counts)
        held = distinct, sums
        if len(distinct) > TASK_PAIRS:
            yield pa.record_batch([pa.array(x) for x in held], ["pair", "docs"])
            held = held[0][:0], held[1][:0]
    yield pa.record_batch([pa.array(x) for x in held], ["pair", "docs"])


def digests(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    small_batches(spark)
    scratch = Scratch(spark, "align")
    rows = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligner(a_path, b_path), _DIGESTED).withColumn("row", F.monotonically_increasing_id()), "rows")
    pairs = scratch.save(pair_counts(rows, scratch), "pairs")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    small = bounded(pairs, PAIR_ROWS, PAIR_BYTES)
    met = links.join(small, "pair") if small is not pairs else join_hot(links, pairs, "pair", hot_keys(pairs, "pair", "docs"))
    sums = scratch.save(met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")), "sums")
    scratch.keep("rows", "sums")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def pair_counts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(pair, docs, best): in how many documents of ``rows`` a pair is linked, and whether that is the most of its id of A."""
    counts = scratch.save(rows.select("pairs").mapInArrow(_counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "counts")
    a = (F.col("pair") / B_IDS).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
