"""Token shards as wavelet matrices: one compressed file per shard, with token access, counting and occurrence lookup.

Texts are encoded with a public tokenizer, an end id is appended to each document, and shards of about ``SHARD_BYTES`` of
text in ascending doc_id order are written to the shared folder. A shard's file holds a JSON header and zstd sections:
doc ids, document lengths, and for each bit of the ids a packed bit-plane and the ones before each of its blocks (rank
directory). Plane k holds the k-th highest bits in the order of the bits above, zeros first, so a token's places form one
run behind the last plane.

Writes are idempotent (a file is written aside and renamed), so a task that runs again after a lost executor leaves the
same bytes.

Defined results: a null text counts as empty (the end id alone); documents order by doc_id (null first), then by a hash of the text;
repeated rows are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import io
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, raw, runs, small_batches
from lodestone.llm.tokens import UnitCache, slices

SHARD_BYTES, SHARD_TOKENS, MAGIC = 24 << 20, 16 << 20, b"LSWM1\n"
#: Bits in a block of the rank directory.
BLOCK = 512
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """A sequence of unsigned ids as bit-planes; all operations read the planes, never a plain copy."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        x = ids
        for level in reversed(range(bits)):
            one = (x & x.dtype.type(1 << level)) != 0
            plane = np.packbits(one)
            planes.append(plane)
            padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(plane)] = plane
            ranks.append(np.concatenate([[0], np.cumsum(_POPCOUNT[padded].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64))]).astype(np.uint32))
            zeros.append(len(x) - int(ranks[-1][-1]))
            x = np.concatenate([x[~one], x[one]])
        return cls(len(ids), planes, zeros, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        first = block * (BLOCK // 8)
        whole, rest = divmod(i - block * BLOCK, 8)
        plane = self.planes[level]
        n = int(self.ranks[level][block]) + int(_POPCOUNT[plane[first : first + whole]].sum())
        return n + (bin(int(plane[first + whole]) >> (8 - rest)).count("1") if rest else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _run(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        bits = len(self.planes)
        if token < 0 or token >> bits:
            return 0, 0
        for level in range(bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        lo, hi = self._run(token, 0, i)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._run(token, lo, self.n if hi is None else hi)
        return b - a

    def _place(self, level: int, k: int, bit: int) -> int:
        """The place of the k-th (from 0) bit of this kind in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * (BLOCK // 8)
        found = np.unpackbits(self.planes[level][first : first + BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(found == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        lo, hi = self._run(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(len(self.planes))):
            zeros = self.zeros[level]
            at = self._place(level, at - zeros, 1) if at >= zeros else self._place(level, at, 0)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence: from the last plane up, each undoes one stable split."""
        bits = len(self.planes)
        x = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in reversed(range(bits)):
            one = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            up = np.empty_like(x)
            up[~one] = x[: self.zeros[level]]
            up[one] = x[self.zeros[level] :] | x.dtype.type(1 << (bits - 1 - level))
            x = up
        return x


def dump(matrix: WaveletMatrix, doc_ids: list, lengths: np.ndarray) -> bytes:
    pack = zstandard.ZstdCompressor(level=1).compress
    sections = [pack(json.dumps(doc_ids).encode()), pack(lengths.astype("<u4").tobytes())]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        sections += [pack(plane.tobytes()), pack(ranks.astype("<u4").tobytes())]
    head = json.dumps({"n": matrix.n, "zeros": matrix.zeros, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


def load(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, doc ids, document lengths) of a shard file."""
    f = io.BytesIO(data)
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a wavelet shard")
    head = json.loads(f.read(int.from_bytes(f.read(4), "little")))
    unpack = zstandard.ZstdDecompressor().decompress
    ids, lengths, *rest = (unpack(f.read(n)) for n in head["sections"])
    planes, ranks = [np.frombuffer(x, np.uint8) for x in rest[::2]], [np.frombuffer(x, "<u4") for x in rest[1::2]]
    return WaveletMatrix(head["n"], planes, head["zeros"], ranks), json.loads(ids), np.frombuffer(lengths, "<u4").astype(np.int64)


#: Letters outside these may be changed or joined by the tokenizer's normaliser: such texts take the plain path.
_OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]|<\\|")
#: The tokenizer's own split pattern (fixed value).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Encoder:
    """Ids by the tokenizers library. Its pieces never cross white space and end with an end-of-word token, so distinct pieces
    are encoded side by side in one text, cut at those tokens, and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.bits = max(1, max(vocabulary.values()).bit_length())
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces = UnitCache(self._encode_pieces, self.dtype, 400_000)
        self.words = UnitCache(self._encode_words, self.dtype, 300_000)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self._library(" ".join(pieces)), self.dtype)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(pieces):
            raise ValueError("a piece has not one end of word")
        return ids, np.diff(last, prepend=-1)

    def _encode_words(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        find = _PIECE.findall
        whole = {i: np.array(self._library(w[0]), self.dtype) for i, w in enumerate(words) if isinstance(w, tuple)}
        flat, sizes = self.pieces.ids([[] if i in whole else find(w.decode()) for i, w in enumerate(words)])
        if whole:
            parts = [whole.get(i, x) for i, x in enumerate(slices(flat, sizes))]
            flat, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return flat, sizes

    @staticmethod
    def split_units(text: bytes) -> list:
        """Lower-cased words; a tuple holds a whole text for the library."""
        if text.isascii():
            return text.lower().split() if b"<|" not in text else [(text.decode(),)]
        s = text.decode(errors="replace")
        return [(s,)] if _OTHER.search(s) else s.lower().encode().split()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.words.ids([self.split_units(t) for t in texts])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """``ids`` with the end id behind each document."""
    out = np.full(len(ids) + len(sizes), end, ids.dtype)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes + 1) - 1] = False
    out[keep] = ids
    return out


def _store(path: str, data: bytes) -> None:
    store, at = fs.FileSystem.from_uri(path)
    aside = f"{at}.{TaskContext.get().taskAttemptId()}.tmp"
    with store.open_output_stream(aside) as f:
        f.write(data)
    store.move(aside, at)


def fetch(path: str) -> bytes:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def write_shards(spark: SparkSession, docs: DataFrame, scratch: Scratch, tokenizer: str, end: int) -> DataFrame:
    """Write the shard files; their list (part, seq, path, n_docs, n_tokens) as a written table, one row per shard."""
    small_batches(spark)
    folder = scratch.path("shards")
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "h"]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = dealt.repartitionByRange(max(1, -(-size // SHARD_BYTES)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, sizes, ids, held = [], [], [], 0

        def flush():
            lengths = np.concatenate(sizes)
            matrix = WaveletMatrix.build(np.concatenate(ids), coder.bits)
            path = f"{folder}/part-{part:06d}-{seq:05d}.wm"
            _store(path, dump(matrix, doc_ids, lengths))
            return pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (path, pa.string()), (len(doc_ids), pa.int64()), (matrix.n, pa.int64()))], ["part", "seq", "path", "n_docs", "n_tokens"])

        for b in batches:
            for texts in runs(raw(b.column(1))):
                got, n = coder.encode(texts)
                ids.append(with_end(got, n, end))
                sizes.append(n + 1)
                held += len(ids[-1])
            doc_ids += b.column(0).to_pylist()
            if held >= SHARD_TOKENS:
                yield flush()
                doc_ids, sizes, ids, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    return scratch.save(dealt.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, shard. The window runs over shards, not documents."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).repartition(max(1, manifest.count()), "path")

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                matrix, doc_ids, lengths = load(fetch(path))
                ids = matrix.decode()
                ends = np.cumsum(lengths)
                wide = np.concatenate([[0], ends]) * 4
                crc, at = [], memoryview(b"")
                for lo in range(0, len(ends), 2000):  # widened a few documents at a time
                    hi = min(lo + 2000, len(ends))
                    first = int(ends[lo] - lengths[lo])
                    at = memoryview(ids[first : int(ends[hi - 1])].astype("<u4").tobytes())
                    crc += [zlib.crc32(at[int(i) - 4 * first : int(j) - 4 * first]) for i, j in zip(wide[lo:hi], wide[lo + 1 : hi + 1], strict=True)]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([path.rsplit("/", 1)[1]] * len(crc), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    return read_shards(spark, write_shards(spark, docs, Scratch(spark, "wavelet"), tokenizer, end))
