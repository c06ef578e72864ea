"""Encoding, decoding, counting and packing against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tallyframe.llm import bpe, packing, token_counts

from .helpers import ODD, empty, odd_docs

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def noise(n=800):
    rng = random.Random(3)
    return ["".join(rng.choice("ab 'st\n\t0,é\x1c\xa0日ll😀") for _ in range(rng.randint(1, 50))) for _ in range(n)] + ["ab" * 2000 + " z", " " * 2500]


def test_codec_equals_libraries():
    texts = [t or "" for t in ODD] + noise()
    own, js = bpe.codec("byte_bpe_50k.tiktoken"), bpe.codec("byte_bpe_50k.json")
    for text, a, b in zip(texts, own.encode_all(texts), js.encode_all(texts), strict=True):
        ids = np.frombuffer(a, "<u4").tolist()
        assert ids == TIK.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert np.frombuffer(b, "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


def test_matrix_equals_heap():
    own = bpe.codec("byte_bpe_50k.tiktoken")
    pieces = [t.encode() for t in noise(200) if t]
    assert own.encode_pieces(pieces) == [own._heap(p) for p in pieces]


def test_memo_generations(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    tok = bpe.codec.__wrapped__("byte_bpe_50k.tiktoken")
    for text in noise(60):
        assert np.frombuffer(next(tok.encode_all([text])), "<u4").tolist() == TIK.encode_ordinary(text)


def test_remembered_words_are_looked_up_once(monkeypatch):
    asked = []
    tok, learn = bpe.codec.__wrapped__("byte_bpe_50k.json"), bpe.Codec._learn
    monkeypatch.setattr(bpe.Codec, "_learn", lambda self, words: asked.append(set(words)) or learn(self, words))
    texts = ["some words, some more", "some words and more " + "x" * 100, "", "more some words, some", "a\u2003b\x1fc d", "a b\u3000", " a", "\na", "a ", "a\n"]
    for _ in range(2):
        got = list(tok.encode_all(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [HF.encode(t, add_special_tokens=False).ids for t in texts]
    # The second time, only the word too long to be remembered.
    assert len(asked) == 2 and asked[1] == {" " + "x" * 100}


def test_each_different_word_of_a_block_is_looked_up_once(monkeypatch):
    asked = []
    tok, look = bpe.codec.__wrapped__("byte_bpe_50k.json"), bpe.Codec._ids
    monkeypatch.setattr(bpe.Codec, "_ids", lambda self, words: asked.extend(words) or look(self, words))
    monkeypatch.setattr(tok, "remember", 3)  # each block starts a generation
    texts = ["a word, a word\nand a word", "", "日本 ümläut 日本 😀", "\n", " a word", "a", "<|endoftext|>a word<|endoftext|> a word", "a\n"] * 20
    for _ in range(3):
        asked.clear()
        got = list(tok.encode_all(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [HF.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(asked) == len(set(asked)) and {" word", "日本", "\n"} <= set(asked)
    for texts in (noise(300), [t or "" for t in ODD], [""], []):
        got = list(tok.encode_all(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [HF.encode(t, add_special_tokens=False).ids for t in texts]


def test_workers_let_go_of_codecs():
    first = bpe.codec("byte_bpe_50k.tiktoken")
    assert list(bpe.slices([], codecs=True)) == [] and bpe.codec("byte_bpe_50k.tiktoken") is first
    assert list(bpe.slices([])) == [] and bpe.codec("byte_bpe_50k.tiktoken") is not first


def test_digest_query(spark):
    docs = odd_docs(spark)
    got = bpe.round_trip_digest(docs).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = ODD[r.doc_id] or ""
        ids = TIK.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bpe.round_trip_digest(empty(docs)).collect() == []


def test_counts(spark):
    docs = odd_docs(spark, noise(100))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_counts.token_counts(docs).collect():
        n = len(HF.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    whole = token_counts.counter("byte_bpe_50k.json").whole
    for text in random.Random(1).sample(sorted(whole), 300):
        assert len(HF.encode(text, add_special_tokens=False).ids) == 1
    assert token_counts.token_counts(empty(docs)).collect() == []


def _whole(rows, texts, capacity):
    """Every document is there whole, every sequence gapless and within capacity."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts.items():
        ids = [*HF.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    docs = odd_docs(spark, noise(300)).dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for group_rows in (20_000, 40):
        rows = packing.pack(docs, capacity=64, group_rows=group_rows, exchange_rows=60).collect()
        n = _whole(rows, texts, 64)
        lengths = np.array([r.length for r in rows])
        assert n >= packing.lower_bound(lengths, 64)
        # Groups of 40 pieces are far below any real size; they may leave a gap each.
        assert n <= -(-int(lengths.sum()) // 64) + (2 if group_rows == 20_000 else 5)
    assert packing.pack(empty(docs)).collect() == []
    cut = lambda n: {(r.doc_id, r.piece, r.ids_crc32) for r in packing.pieces(docs, "byte_bpe_50k.json", 64, 0, n).collect()}
    assert cut(3) == cut(bpe.MEMO)


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = rng.integers(1, 65, rng.integers(1, 60))
        bins, _, left = packing.best_fit_decreasing(lengths, 64)
        assert packing.lower_bound(lengths, 64) <= len(left)
    assert packing.lower_bound(np.array([40] * 7), 64) == 7
    assert packing.lower_bound(np.array([22] * 6), 64) == 3
