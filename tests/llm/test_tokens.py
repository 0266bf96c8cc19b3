"""Token files and byte-pair encoding against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import bpe, wavelet
from lodestone.llm.common import Scratch

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(BYTE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_byte_bpe(spark, reference, name, request):
    docs = request.getfixturevalue(name)
    want = sorted((str(r.doc_id), len(ids := reference.encode_ordinary(r.text or "")), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = bpe.digests(spark, docs, BYTE, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_byte_bpe_odd_texts(reference):
    coder, rng = bpe.Encoder(bpe.Vocabulary.load(BYTE), public_tokenizers.PATTERN), random.Random(2)
    texts = ["", " ", "\n", "a  b", " a", "a ", "a\n\nb", "a \n b", "\ta\x0bb\x0c\r\nc", "a\u00a0b \u2003 c\u3000", "\x1ca\x1d b\x1e\x85c", "it's we'll 'S I'd", "x" * 700, "ab" * 400 + "1" * 300, "日本語テキスト" * 60, "e\u0301 \u200b \u180e \ufeff", "😀😀 😀", "\x00\x00 \x00", "#" * 300 + "é" * 300]
    texts += ["".join(rng.choice("ab é1.'s\n\t#日") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    ids, sizes = coder.encode(texts)
    for t, x in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert x.tolist() == reference.encode_ordinary(t), repr(t)
        assert coder.vocabulary.decode(x).decode() == t


def test_long_pieces_equal_the_matrix(reference):
    words = bpe.Vocabulary.load(BYTE)
    rng = random.Random(3)
    pieces = ["".join(rng.choice("etaoinshé") for _ in range(rng.randint(2, 250))).encode() for _ in range(100)]
    for p, ids in zip(pieces, words.encode_pieces(pieces), strict=True):
        if p not in words.ranks:
            assert list(ids) == words._row(p).tolist()


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
def test_wavelet_round_trip(spark, name, request, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 100_000)
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 20_000)
    docs = request.getfixturevalue(name)
    plain = Tokenizer.from_file(WORD)
    plain.encode_special_tokens = True
    start, want = 0, []
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((str(r.doc_id), start, len(ids), zlib.crc32(u32(ids))))
        start += len(ids)
    got = wavelet.round_trip(spark, docs, WORD).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_wavelet_operations():
    rng = np.random.default_rng(4)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice(np.array([0, 1, 2, 77, 40000, 49407], np.uint16), n)
        w, doc_ids, lengths = wavelet.load(wavelet.dump(wavelet.WaveletMatrix.build(ids, 16), [1, None], np.array([n, 0])))
        assert w.decode().tolist() == ids.tolist() and doc_ids == [1, None] and lengths.tolist() == [n, 0]
        for i in range(0, n, 37):
            assert w.access(i) == ids[i]
        for token in (0, 77, 49407, 5, 1 << 20):
            at = np.flatnonzero(ids == token) if token < 65536 else np.zeros(0)
            assert w.count(token) == len(at) and w.rank(token, n // 2) == (at < n // 2).sum()
            assert [w.select(token, k) for k in range(0, len(at), 53)] == at[::53].tolist()
            with pytest.raises(IndexError):
                w.select(token, len(at))


def test_word_units_equal_the_library():
    coder, rng = wavelet.Encoder(WORD), random.Random(6)
    texts = ["It's THE end", "ÉCLAIR Straße ÀÿÞ", "İstanbul ǅ K", "a\x1cb\x85c\xa0d", "x<|endoftext|>y <|ENDOFTEXT|>", "12,3 #$%&&& a.b.c", "e\u0301a", "ß\u00d7\u00f7\u00aa\u00b5", "\x00a\x7f"]
    texts += ["".join(rng.choice("aB é1.'sÇ\n\t#<|日") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    ids, sizes = coder.encode([t.encode() for t in texts])
    for t, x in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert x.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_manifest_lists_files(spark, documents):
    shards = wavelet.write_shards(spark, documents, Scratch(spark, "test"), WORD, 2).collect()
    w, ids, lengths = wavelet.load(wavelet.fetch(shards[0].path))
    assert ids == sorted(ids) and lengths.sum() == w.n == shards[0].n_tokens and w.count(2) >= len(ids)
    assert regex.search(r"part-\d+-\d+\.wm$", shards[0].path)
