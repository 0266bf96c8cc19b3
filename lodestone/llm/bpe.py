"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces of the split pattern are gathered by byte length into matrices, one row per piece, padded to the bucket's width.
In each round every row merges its leftmost pair of minimum rank: the pair's rank comes from an open-addressing hash
table of (left id, right id), the merged cell is written, and the cell behind it is squeezed out; rows without a pair
left leave the matrix. Only the two pairs beside a merge are looked up again. A piece longer than ``LONG`` bytes is a row of its
own, in which a round merges all places of the minimum-rank pair that leftmost-first merging would come to in turn, so
that its rounds follow the number of distinct merges and not its length.

Units of text (a run of white space and the word behind it) are remembered with their ids, since no piece crosses from a
word into white space.

Defined results: a null text counts as empty (no tokens, hashes of nothing); repeated rows and ids keep their rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import raw, runs, small_batches
from lodestone.llm.tokens import UnitCache, ragged, slices

WIDTHS, LONG = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256), 256
PAD = np.uint32(0xFFFF)
_NONE = np.uint32(0xFFFFFFFF)


class PairTable:
    """Hash table of (left id, right id) -> merged id, with linear probing; ids are below 2^16 - 1."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a << 16 | b] = rank
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, _NONE, np.uint32)
        self.values = np.full(1 << self.bits, _NONE, np.uint32)
        keys, values = np.array(list(pairs), np.uint32), np.array(list(pairs.values()), np.uint32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == _NONE
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs; the largest number where there is none."""
        keys = (left << np.uint32(16)) | right
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], _NONE)
        todo = np.flatnonzero((seen != keys) & (seen != _NONE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (1 << self.bits) - 1
            seen = self.keys[slot[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen != _NONE)]
        return out


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 0xFFFF:
            raise ValueError("ids must be below 65535")
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.uint32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[Sequence[int]]:
        """Ids of each piece: its own if it is a token, else by merges."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (own := self.ranks.get(p)) is not None:
                out[i] = (own,)
            elif len(p) > LONG:
                out[i] = self._row(p)
            elif p:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(p)), []).append(i)
            else:
                out[i] = ()
        for width, rows in by_width.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode_flat(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and the number of each one's."""
        ids = self.encode_pieces(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cells = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.single[cells], PAD)
        ranks = np.full(ids.shape, _NONE, np.uint32)  # of the pair that starts in the cell
        ranks[:, :-1] = self.pairs.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        row, out = np.arange(len(ids)), [None] * len(ids)
        while len(ids):
            at = ranks.argmin(axis=1)  # the first of equal ones: the leftmost
            low = ranks[np.arange(len(ids)), at]
            if (over := low == _NONE).any():
                for r in np.flatnonzero(over):
                    out[row[r]] = ids[r, : size[r]].tolist()
                ids, ranks, row, size, at, low = (x[~over] for x in (ids, ranks, row, size, at, low))
                if not len(ids):
                    break
            n = np.arange(len(ids))
            ids[n, at] = low
            keep = np.ones(ids.shape, bool)
            keep[n, at + 1] = False
            ids, ranks = (x[keep].reshape(len(n), -1) for x in (ids, ranks))
            size = size - 1
            last = ids.shape[1] - 1
            ranks[n, at] = np.where(at < last, self.pairs.merged(low, ids[n, np.minimum(at + 1, last)]), _NONE)
            ahead = np.flatnonzero(at > 0)
            ranks[ahead, at[ahead] - 1] = self.pairs.merged(ids[ahead, at[ahead] - 1], low[ahead])
        return out

    def _row(self, piece: bytes) -> np.ndarray:
        """The merges of one long piece. Merging the leftmost place may bring up a pair of lower rank beside it, which then comes
        first; the round ends at the first such place."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.merged(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == low)
            # of places in a row, which share a cell, each second one is taken
            head = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))) % 2 == 0]
            after = np.diff(at, prepend=-2) == 2  # the cell before is the one merged just now
            left = np.where(after, low, ids[at - 1])
            first, last = (0 if at[0] else 1), len(at) - (at[-1] + 2 >= len(ids))
            lower = np.zeros(len(at), bool)
            lower[first:] = self.pairs.merged(left[first:], np.full(len(at) - first, low)) < low
            lower[:last] |= self.pairs.merged(np.full(last, low), ids[at[:last] + 2]) < low
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks = ids[keep], np.append(ranks, _NONE)[keep][:-1]
            now = at - np.arange(len(at))
            right, before = now[now + 1 < len(ids)], now[now > 0] - 1
            ranks[right] = self.pairs.merged(ids[right], ids[right + 1])
            ranks[before] = self.pairs.merged(ids[before], ids[before + 1])
        return ids


_UNIT = regex.compile(r"\s*\S+|\s+$")


class Encoder:
    """Texts to ids by a vocabulary and a split pattern."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)
        self.pieces = UnitCache(vocabulary.encode_flat, np.uint32, 300_000)
        self.units = UnitCache(self._encode_units, np.uint32, 200_000)

    def _encode_units(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        find = self.split.findall
        return self.pieces.ids([[p.encode() for p in find(u[0] if isinstance(u, tuple) else u if u[0] == "\n" else " " + u)] for u in units])

    @staticmethod
    def split_units(text: str) -> list:
        """Units: a string stands for a blank and itself (or for itself, if it starts with a line end), a tuple for its text."""
        words, blanks = text.split(), text.count(" ") + text.count("\n")
        if len(words) != blanks + 1 or sum(map(len, words)) + blanks != len(text):  # not just single blanks and line ends between words
            return [(u,) for u in _UNIT.findall(text)]
        units: list = text.replace("\n", " \n").split(" ")
        units[0] = (units[0],)
        return units

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.units.ids([self.split_units(t) for t in texts])


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern)


def _ids(coder: Encoder, texts: list[bytes]) -> Iterator[np.ndarray]:
    """Ids of each text, little-endian; a few megabytes of text are in work at a time."""
    for part in runs(texts):
        ids, sizes = coder.encode([t.decode(errors="replace") for t in part])
        yield from slices(ids.astype("<u4"), sizes)


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit)."""
    small_batches(spark)

    def run(batches):
        coder = encoder(path, pattern)
        for b in batches:
            ids = [x.tobytes() for x in _ids(coder, raw(b.column(1)))]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(spark: SparkSession, encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded bytes as ``data``."""
    small_batches(spark)

    def run(batches):
        words = encoder(path, pattern).vocabulary
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([words.decode(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids", "data"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, data binary")


def digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. One Python step: each more would hold a vocabulary of its own."""
    small_batches(spark)

    def run(batches):
        coder = encoder(path, pattern)
        for b in batches:
            n, ids, data = [], [], []
            for x in _ids(coder, raw(b.column(1))):
                n.append(len(x))
                ids.append(hashlib.sha256(x).hexdigest())
                data.append(hashlib.sha256(coder.vocabulary.decode(x)).hexdigest())
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
