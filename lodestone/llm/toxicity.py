"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word enters as the sum of a hashed word vector and the mean of the hashed vectors of its character (byte) 3- and 5-grams. Windows of ``WINDOW``
words start every ``STRIDE`` words, so that neighbours share eight and every word lies in one or two; each is read in both directions, its
states are pooled by attention, and a logistic unit gives the window's probability. A document's score is that of its
highest window. The network is trained here, in numpy, from document labels alone: the loss takes a document as toxic if
any of its windows is (noisy or). Only the text is an input.

Trained on a bounded sample: of the labelled rows whose crc32 is not set aside and whose text has at most ``TRAIN_WORDS`` words,
the ``TRAIN_DOCS`` with the smallest id hashes. Scored are all windows of all documents, however long.

Defined results: a null text counts as empty; a text without words is one window of blanks; repeated rows get equal scores;
an empty table gives an empty result; without labels of both kinds every score is the untrained bias; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import raw, runs, small_batches
from lodestone.llm.tokens import ragged

WINDOW, STRIDE, THRESHOLD = 24, 16, 0.3
#: Bounds of the training sample; a batch ends at ``BATCH`` documents or ``BATCH_WORDS`` words.
TRAIN_DOCS, TRAIN_WORDS, EPOCHS, BATCH, BATCH_WORDS, RATE = 4000, 1000, 8, 64, 16_000, 0.01
HIDDEN, WIDTH, WORD_SLOTS, CHAR_SLOTS = 8, 16, 1 << 14, 1 << 14
_EDGE = bytes(i for i in range(128) if not chr(i).isalnum())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def _hash(h: np.ndarray, slots: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x7FEB352D)
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x846CA68B)
    return ((h ^ (h >> np.uint32(16))) % np.uint32(slots)).astype(np.int64)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words, slots of all their character grams end to end, and how many grams each word has."""
    forms = [b"^" + w.decode(errors="replace").lower().encode().strip(_EDGE) + b"$$$$" for w in words]
    sizes = np.fromiter(map(len, forms), np.int64, len(forms))
    a = np.concatenate([np.frombuffer(b"".join(forms), np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    tri = a[:-4] << np.uint32(16) | a[1:-3] << np.uint32(8) | a[2:-2]
    five = (tri * np.uint32(0x9E3779B1)) ^ (a[3:-1] << np.uint32(8) | a[4:]) * np.uint32(0x85EBCA6B)
    own = np.ones(len(tri), bool)
    for back in range(1, 5):
        own[starts + sizes - back] = False
    grams = np.stack([_hash(tri[own], CHAR_SLOTS), _hash(five[own] ^ np.uint32(0x5BD1E995), CHAR_SLOTS)], 1)
    begin = starts - 4 * np.arange(len(forms))
    # a word's hash sums its scrambled 5-grams and their places
    place = np.arange(len(tri), dtype=np.int64)[own] - np.repeat(starts, sizes - 4)
    mixed = five[own] * (2 * place + 0x9E3779B1).astype(np.uint32) ^ (five[own] >> np.uint32(7))
    return _hash(np.add.reduceat(mixed, begin, dtype=np.uint32), WORD_SLOTS), grams.ravel(), 2 * (sizes - 4)


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and the sums of their rows."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    return at[order[first]], np.add.reduceat(rows[order], first, axis=0)


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words; the last one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; 0 and 1 tell the directions. A word's input to the gates is (word + chars) @ W + b."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.normal(size=shape) * s).astype(np.float32)
        self.p = {"word": draw(WORD_SLOTS, WIDTH, s=0.05), "char": draw(CHAR_SLOTS, WIDTH, s=0.2), "v": draw(2 * HIDDEN, s=0.1), "o": draw(2 * HIDDEN, s=0.3), "c": np.full(1, -3, np.float32)}
        for d in "01":
            self.p |= {"W" + d: draw(WIDTH, 3 * HIDDEN, s=0.4), "U" + d: draw(HIDDEN, 3 * HIDDEN, s=0.3), "b" + d: np.zeros(3 * HIDDEN, np.float32)}

    def vectors(self, slot: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.p["word"][slot] + np.add.reduceat(self.p["char"][chars], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions, side by side."""
        return np.concatenate([vectors @ self.p["W0"] + self.p["b0"], vectors @ self.p["W1"] + self.p["b1"]], axis=1)

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: [time, windows, 6 * HIDDEN] gate inputs; states of both directions [time, windows, 2 * HIDDEN]."""
        steps, n, _ = x.shape
        h = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for d in (0, 1):
            u, last = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
            at = slice(d * HIDDEN, (d + 1) * HIDDEN)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = x[t, :, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN]
                q = last @ u
                rz = _sigmoid(g[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])
                cand = np.tanh(g[:, 2 * HIDDEN :] + rz[:, :HIDDEN] * q[:, 2 * HIDDEN :])
                z = rz[:, HIDDEN:]
                new = cand + z * (last - cand)
                if keep is not None:
                    keep.append((d, t, last, rz, cand, q[:, 2 * HIDDEN :]))
                h[t, :, at] = last = new
        return h

    def pool(self, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights, pooled states and logits; mask [time, windows] marks real words."""
        e = np.where(mask, h @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, h)
        return a, pooled, pooled @ self.p["o"] + self.p["c"][0]


def _grid(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word places [time, windows] of windows that begin at starts and may not pass ends, and which are real."""
    at = starts + np.arange(WINDOW)[:, None]
    mask = at < ends
    mask[0] = True
    return np.where(at < ends, at, 0), mask


def _gradients(net: Network, docs: list[np.ndarray], toxic: np.ndarray, vectors: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the noisy-or loss over a batch of documents (arrays of word numbers), by backpropagation."""
    p, h3 = net.p, 3 * HIDDEN
    flat = np.concatenate(docs)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    starts = [windows(n) for n in sizes]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    at, mask = _grid(np.concatenate(starts) + (ends - sizes)[owner], ends[owner])
    ids = flat[at]
    x = net.inputs(vectors)[ids]
    x[~mask] = 0
    keep: list = []
    h = net.states(x, keep)
    a, pooled, logit = net.pool(h, mask)
    prob = np.clip(1 / (1 + np.exp(-logit)), 1e-6, 1 - 1e-6)
    clean = np.exp(np.bincount(owner, np.log1p(-prob), len(docs)))  # no window is toxic
    any_ = np.clip(1 - clean, 1e-6, 1)
    d_logit = np.where(toxic[owner], -(1 - any_[owner]) / any_[owner], 1) * prob / len(docs)
    loss = -np.where(toxic, np.log(any_), np.log(np.clip(clean, 1e-30, 1))).mean()
    d_logit = d_logit.astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
    g["c"][0], g["o"] = d_logit.sum(), d_logit @ pooled
    d_pool = d_logit[:, None] * p["o"]
    d_a = np.einsum("nh,tnh->tn", d_pool, h)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["v"] = np.einsum("tn,tnh->h", d_e, h)
    d_h = a[:, :, None] * d_pool + d_e[:, :, None] * p["v"]
    d_x = np.zeros_like(x)
    carry = {0: 0, 1: 0}
    for d, t, last, rz, cand, qc in reversed(keep):
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        dh = d_h[t, :, d * HIDDEN : (d + 1) * HIDDEN] + carry[d]
        d_cand = dh * (1 - z) * (1 - cand**2)
        d_z = dh * (last - cand) * z * (1 - z)
        d_r = d_cand * qc * r * (1 - r)
        d_q = np.concatenate([d_r, d_z, d_cand * r], axis=1)
        d_x[t, :, d * h3 : (d + 1) * h3] = np.concatenate([d_r, d_z, d_cand], axis=1)
        g[f"U{d}"] += last.T @ d_q
        carry[d] = dh * z + d_q @ p[f"U{d}"].T
    d_x[~mask] = 0
    used, total = _summed(ids.ravel(), d_x.reshape(-1, 2 * h3))
    d_in = np.zeros((len(vectors), 2 * h3), np.float32)
    d_in[used] = total
    d_vec = 0
    for d in (0, 1):
        part = d_in[:, d * h3 : (d + 1) * h3]
        g[f"W{d}"], g[f"b{d}"] = vectors.T @ part, part.sum(axis=0)
        d_vec = d_vec + part @ p[f"W{d}"].T
    return g, d_vec, float(loss)


def _batches(order: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    batch, held = [], 0
    for i in order.tolist():
        if batch and (len(batch) == BATCH or held + len(docs[i]) > BATCH_WORDS):
            yield np.array(batch)
            batch, held = [], 0
        batch.append(i)
        held += len(docs[i])
    if batch:
        yield np.array(batch)


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> Network:
    """Adam over batches of documents."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if len(set(toxic.tolist())) < 2:
        return net
    numbers: dict[bytes, int] = {}
    whole = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split() or [b""]]) for t in texts]
    all_slots, all_chars, all_sizes = features(list(numbers))
    all_starts = np.cumsum(all_sizes) - all_sizes
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(whole))
        for batch in _batches(order, whole):
            words, flat = np.unique(np.concatenate([whole[i] for i in batch]), return_inverse=True)
            docs = np.split(flat, np.cumsum([len(whole[i]) for i in batch])[:-1])
            slot, sizes = all_slots[words], all_sizes[words]
            chars = ragged(all_chars, all_starts[words], sizes)
            vectors = net.vectors(slot, chars, sizes)
            g, d_vec, _ = _gradients(net, docs, toxic[batch], vectors)
            step += 1
            rows = {"word": (slot, d_vec), "char": (chars, np.repeat((d_vec / sizes[:, None]).astype(np.float32), sizes, axis=0))}
            for k, (at, d) in rows.items():  # only the rows in use are touched
                used, total = _summed(at, d)
                first[k][used] = 0.9 * first[k][used] + 0.1 * total
                second[k][used] = 0.99 * second[k][used] + 0.01 * total**2
                net.p[k][used] -= rate * first[k][used] / (np.sqrt(second[k][used]) + 1e-6)
            for k, d in g.items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d**2
                fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                net.p[k] -= rate * fix * first[k] / (np.sqrt(second[k]) + 1e-6)
    return net


class Scorer:
    """A trained network with the gate inputs of the words it has met; forgotten at ``limit`` words."""

    def __init__(self, net: Network, limit: int = 150_000):
        self.net, self.limit = net, limit
        self.numbers: dict[bytes, int] = {}
        self.x = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            n = len(self.numbers)
            while n + len(part) > len(self.x):
                self.x = np.concatenate([self.x, np.zeros_like(self.x)])
            self.x[n : n + len(part)] = self.net.inputs(self.net.vectors(*features(part)))
            self.numbers.update(zip(part, range(n, n + len(part)), strict=True))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The highest window of each text."""
        if len(self.numbers) > self.limit:
            self.numbers = {}
        split = [t.split() or [b""] for t in texts]
        get = self.numbers.get
        self._learn(list(dict.fromkeys(w for s in split for w in s if w not in self.numbers)))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((get(w) for s in split for w in s), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        starts = [windows(n) for n in sizes]
        count = np.fromiter(map(len, starts), np.int64, len(starts))
        owner = np.repeat(np.arange(len(split)), count)
        begin = np.concatenate(starts) + (ends - sizes)[owner]
        logit = np.empty(len(begin), np.float32)
        for lo in range(0, len(begin), 2048):
            at, mask = _grid(begin[lo : lo + 2048], ends[owner[lo : lo + 2048]])
            x = self.x[flat[at]]
            if not mask.all():
                x[~mask] = 0
            logit[lo : lo + 2048] = self.net.pool(self.net.states(x), mask)[2]
        return _sigmoid(np.maximum.reduceat(logit, np.cumsum(count) - count).astype(np.float64))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Network:
    """Train on the bounded sample, on the driver; an id on several rows counts with its first text in order."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("toxic").alias("toxic"))
    # ids meet labels without their texts; the texts of the sample alone follow
    short = docs.select(F.col("doc_id").cast("long").alias("i"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")).alias("n")).where(F.col("n") <= TRAIN_WORDS).groupBy("i").agg(F.max("n").alias("n"))
    sample = short.join(told, "i").orderBy(F.xxhash64("i"), "i").limit(TRAIN_DOCS).select("i", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), "text").join(F.broadcast(sample), "i").where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")) <= TRAIN_WORDS)
    got = texts.groupBy("i", "toxic").agg(F.min("text").alias("text")).orderBy("i").collect()
    return train([r["text"].encode() for r in got], np.array([r["toxic"] == 1 for r in got], bool))


_SCORERS: dict = {}


def judge(spark: SparkSession, docs: DataFrame, net: Network) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        if shared.value not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[shared.value] = Scorer(shared.value)
        for b in batches:
            parts = [_SCORERS[shared.value].scores(texts) for texts in runs(raw(b.column(1)))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
