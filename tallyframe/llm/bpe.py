"""Byte-level BPE encoding and decoding on padded numpy matrices.

A worker keeps one :class:`Codec` per vocabulary. Text is cut into pre-tokens by
the vocabulary's pattern; pre-tokens not seen lately are bucketed by byte length
into padded id matrices, and each round every row merges its leftmost pair of
minimum rank. Pairs are looked up in an open-addressing hash table held in numpy
arrays, a merged row is compacted by one gather, and rows without a mergeable
pair leave the matrix. Pre-tokens beyond ``LONG`` bytes use a heap over a linked
list, so one huge pre-token costs n log n and not n squared.

Memory per worker is bounded: the vocabulary tables, two generations of a memo
of at most ``MEMO`` entries each, and one block of about ``BLOCK`` characters.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes from which a pre-token is merged by the heap.
LONG = 1024
#: Entries of one memo generation, and the longest key that is remembered.
MEMO, MEMO_KEY = 450_000, 48
#: Characters of text that are cut up at a time.
BLOCK = 4_000_000
_NONE = np.int32(2**31 - 1)
#: White space as the Rust tokenizer libraries define it (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"


def vocabulary_path(name: str) -> str:
    """A vocabulary file: an absolute path as it is, else one of the installed public ones."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _compile(pattern: str) -> regex.Pattern:
    """The pattern with ``\\s`` and ``\\S`` spelled out, as Python's differ in the control characters."""
    inside = regex.sub(r"\[\^\\s", lambda _: f"[^{_SPACE}", pattern)
    return regex.compile(inside.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in JSON vocabularies: printable Latin-1 stands for
    itself, the other bytes, in order, for the code points from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """(left id, right id) -> (rank, merged id) by linear probing in numpy arrays."""

    def __init__(self, left, right, rank, merged):
        key = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        self.bits = max(10, int(len(key) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.rank = np.full(1 << self.bits, _NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        self.by_rank = np.zeros(int(rank.max(initial=-1)) + 1, np.int32)  # a rank stands for one merged id
        self.by_rank[rank] = merged
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == 2**64 - 1
            at = todo[free]
            _, first = np.unique(slot[at], return_index=True)
            put = at[first]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = key[put], rank[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Slots of the pairs; a slot whose rank is ``_NONE`` stands for an absent pair."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(key)
        seen = self.keys[slot]
        open_ = np.flatnonzero((seen != key) & (seen != 2**64 - 1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            open_ = open_[(seen != key[open_]) & (seen != 2**64 - 1)]
        return slot


class Codec:
    """Encoder and decoder of one byte-level vocabulary.

    ``special`` maps strings that the library takes out of a text before it
    splits the rest to their ids; empty for plain rank files.
    """

    def __init__(self, tokens: list[bytes], byte_ids, table: PairTable, pattern: str, special: dict[str, int]):
        self.tokens, self.byte_ids, self.table, self.special = tokens, byte_ids, table, special
        self.decimal = [str(i) for i in range(len(tokens))]
        self.pattern = _compile(pattern)
        self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.remember = MEMO
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    # ---- merging -------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as little-endian uint32 bytes, of each pre-token by itself."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        at = int(np.searchsorted(sizes[order], 1))
        while at < len(order):
            size = int(sizes[order[at]])
            if size > LONG:
                for i in order[at:].tolist():
                    out[i] = self._heap(pieces[i])
                break
            widest = size if size <= 16 else min(LONG, size + size // 4)
            end = min(int(np.searchsorted(sizes[order], widest, "right")), at + max(1, 400_000 // widest))
            rows = order[at:end]
            self._matrix([pieces[i] for i in rows.tolist()], rows, out)
            at = end
        return out

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, out: list[bytes]) -> None:
        n, width = len(pieces), max(map(len, pieces))
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        ids[np.arange(width) >= size[:, None]] = -1
        rank = np.full((n, max(width - 1, 1)), _NONE, np.int32)
        if width > 1:
            r, c = np.nonzero(ids[:, 1:] >= 0)
            rank[r, c] = self.table.rank[self.table.find(ids[r, c], ids[r, c + 1])]
        while n:
            best = rank.argmin(axis=1)  # argmin gives the leftmost of equal ranks
            least = rank[np.arange(n), best]
            done = least == _NONE
            if done.any():
                for k in np.unique(size[done]).tolist():
                    pick = np.flatnonzero(done & (size == k))
                    flat, step = ids[pick, :k].astype("<u4").tobytes(), 4 * k
                    for j, i in enumerate(rows[pick].tolist()):
                        out[i] = flat[j * step : (j + 1) * step]
                keep = np.flatnonzero(~done)
                ids, rank, size, rows, best, least = ids[keep], rank[keep], size[keep], rows[keep], best[keep], least[keep]
                n = len(keep)
                if not n:
                    return
                width = int(size.max())
                ids, rank = ids[:, :width], rank[:, : max(width - 1, 1)]
            every = np.arange(n)
            ids[every, best] = self.table.by_rank[least]
            width -= 1
            if width == 0:
                width = 1
            col = np.arange(width)
            take = col + (col > best[:, None])  # drop the right half of the merged pair
            np.minimum(take, ids.shape[1] - 1, out=take)
            ids = np.take_along_axis(ids, take, axis=1)
            size -= 1
            ids[col >= size[:, None]] = -1
            gaps = max(width - 1, 1)
            take = take[:, :gaps]
            rank = np.take_along_axis(rank, np.minimum(take, rank.shape[1] - 1), axis=1)
            rank[np.arange(gaps) >= (size - 1)[:, None]] = _NONE
            for shift in (0, -1):
                c = best + shift
                r = np.flatnonzero((c >= 0) & (c + 1 < size))
                cc = c[r]
                rank[r, cc] = self.table.rank[self.table.find(ids[r, cc], ids[r, cc + 1])]

    def _heap(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        table, n = self.table, len(ids)
        slots = table.find(ids[:-1], ids[1:])
        ranks = table.rank[slots].tolist()
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i] = int(table.merged[table.find(np.array([left]), np.array([right]))[0]])
            ids[j] = -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    r = int(table.rank[table.find(np.array([ids[a]]), np.array([ids[b]]))[0]])
                    if r != _NONE:
                        heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    # ---- texts ---------------------------------------------------------
    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words (each with the space before it) that the memo lacks; those of ordinary length are put there."""
        memo, out = self._memo, {}
        whole, cut = [], []
        for w in words:
            if (w[1:] if w[:1] == " " else w).isalpha():
                whole.append(w)
            else:
                cut.append((w, pieces_of(w, self.pattern)))
        pieces = list({p for _, ps in cut for p in ps if p not in memo}.union(whole))
        ids = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces]), strict=True))
        for w in whole:
            out[w] = ids[w]
        for w, ps in cut:
            out[w] = b"".join([ids[p] if p in ids else memo[p] for p in ps])
        memo.update(out if max(map(len, out), default=0) <= MEMO_KEY else {w: x for w, x in out.items() if len(w) <= MEMO_KEY})
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of every word; those in the memo are looked up once and touched no more."""
        if len(self._memo) > self.remember:
            self._old, self._memo = self._memo, {}
        ids = list(map(self._memo.get, words))
        at = [i for i, x in enumerate(ids) if x is None]
        if at and self._old:
            lacking = [words[i] for i in at]
            aged = list(map(self._old.get, lacking))
            self._memo.update((w, x) for w, x in zip(lacking, aged, strict=True) if x is not None)
            for i, x in zip(at, aged, strict=True):
                ids[i] = x
            at = [i for i, x in zip(at, aged, strict=True) if x is None]
        if at:
            lacking = [words[i] for i in at]
            new = self._learn(set(lacking))
            for i, x in zip(at, map(new.__getitem__, lacking), strict=True):
                ids[i] = x
        return ids

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32 bytes."""
        with uncollected():
            return self._encode_block(texts)

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        plain: list[bytes] = []  # parts that are cut at their white space, all at once
        words: list[str] = []  # pre-tokens of the other parts
        cut: list[list] = []
        for text in texts:
            parts: list = []
            for k, part in enumerate(self._special.split(text) if self._special and self._special.search(text) else [text]):
                if k % 2:
                    parts.append(np.array([self.special[part]], "<u4").tobytes())
                elif part and is_plain(part):
                    parts.append(len(plain))
                    plain.append(part.encode())
                elif part:
                    at = len(words)
                    words += self.pattern.findall(part)
                    parts.append(slice(at, len(words)))
            cut.append(parts)
        data, ends, ids = self._block_ids(plain, words)
        out = []
        for parts in cut:
            found = (part if type(part) is bytes else b"".join(ids[part]) if type(part) is slice else data[ends[part] : ends[part + 1]] for part in parts)
            out.append(b"".join(found))
        return out

    def _block_ids(self, parts: list[bytes], others: list[str]) -> tuple[memoryview, list[int], list[bytes]]:
        """Ids of all plain parts one after the other and where each part's begin, and those of other pre-tokens; each different word of the parts is looked up once."""
        if not parts:
            return memoryview(b""), [0], self._ids(others)
        raw = b"".join(parts)
        first = np.cumsum([0, *map(len, parts)])
        start = word_starts(raw, first[:-1])
        offsets = pa.py_buffer(np.append(start, len(raw)))
        words = pa.LargeStringArray.from_buffers(len(start), offsets, pa.py_buffer(raw)).dictionary_encode()
        found = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist() + others)
        different = len(words.dictionary)
        ids = pa.array(found[:different], pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(start) + 1]
        return memoryview(data if data is not None else b""), ends[np.searchsorted(start, first)].tolist(), found[different:]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of many texts, a bounded block at a time; null counts as empty."""
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= BLOCK:
                yield from self.encode_block(block)
                block, size = [], 0
        if block:
            yield from self.encode_block(block)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens."""
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def codec(name: str, pattern: str | None = None) -> Codec:
    """The worker's codec of a ``.tiktoken`` rank file or a byte-level ``.json`` vocabulary."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = vocabulary_path(name)
    special: dict[str, int] = {}
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        raw = {s: bytes(byte_of[c] for c in s) for s in spec["model"]["vocab"] if all(c in byte_of for c in s)}
        ids = {raw[s]: i for s, i in spec["model"]["vocab"].items() if s in raw}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(raw[a], raw[b]) for a, b in pairs]
        rows = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    else:
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        rows = [(ids[t[:k]], ids[t[k:]], i, i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for t, i in [*ids.items(), *((s.encode(), i) for s, i in special.items())]:
        tokens[i] = t
    byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
    return Codec(tokens, byte_ids, PairTable(*map(list, zip(*rows, strict=True))), pattern, special)


#: What a worker keeps between tasks.
CACHES = [codec]


@contextlib.contextmanager
def uncollected():
    """No cycle collection meanwhile: millions of strings and tuples are made, and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


#: White space that is no space or line feed, the mark of a cut, and white space in a row.
_UNSAFE = (*re.findall(r"[^\S \n]", "".join(map(chr, range(0x3001)))), "\0", "  ", " \n", "\n ", "\n\n")


def words_of(text: str) -> list[str] | None:
    """The text cut before every single space and around every single line feed, where pre-tokens
    always end; None where other white space makes such cuts unsafe."""
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if is_plain(text) else None


def is_plain(text: str) -> bool:
    """Whether pre-tokens end before every single space and around every single line feed; other white space
    can make such cuts unsafe."""
    if text.endswith(" "):
        return False
    for s in _UNSAFE:  # a plain search for each is faster than one pattern
        if s in text:
            return False
    return True


def word_starts(raw: bytes, first: np.ndarray) -> np.ndarray:
    """Where the words of plain texts begin, in the bytes of all texts: with each text, at spaces, at line feeds and after them."""
    at = np.frombuffer(raw, np.uint8)
    starts = np.zeros(len(at) + 1, bool)
    starts[first] = True
    feeds = np.flatnonzero(at == 10)
    starts[feeds] = starts[feeds + 1] = True
    starts[:-1] |= at == 32
    return np.flatnonzero(starts[:-1])


def pieces_of(word: str, pattern: regex.Pattern) -> list[str]:
    """Pre-tokens of a word; the commonest shapes need no pattern."""
    bare = word[1:] if word[:1] == " " else word
    if bare.isalpha():
        return [word]
    if bare[:-1].isalpha() and bare[-1] in ".,;:!?":
        return [word[:-1], bare[-1]]
    return pattern.findall(word)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, *, codecs: bool = False) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into a few rows each, so that Python strings of one slice exist at a time.

    Workers outlive stages: one that needs no ``codecs`` lets go of those that a stage before it left, with all they remember.
    """
    for kept in () if codecs else CACHES:
        kept.cache_clear()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: ``doc_id, ids binary`` (little-endian unsigned 32-bit ids).

    Null and empty texts give no ids. Other columns, whatever their names, are not read. Repeated rows
    give a row each.
    """

    def run(batches):
        tok = codec(vocabulary)
        for b in slices(batches, codecs=True):
            yield pa.record_batch([b.column(0), pa.array(list(tok.encode_all(b.column(1).to_pylist())), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids binary")


def decode(tokens: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Bytes of token ids as :func:`encode` gives them: ``doc_id, data binary``."""

    def run(batches):
        tok = codec(vocabulary)
        for b in slices(batches, codecs=True):
            data = [tok.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


def round_trip_digest(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Encode, then decode the ids, in one pass over the texts: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The ids and bytes themselves never leave the worker; :func:`encode` and :func:`decode` return them.
    Null text counts as empty (no tokens, digests of the empty string).
    """

    def run(batches):
        tok = codec(vocabulary)
        for b in slices(batches, codecs=True):
            counts, encoded, decoded = [], [], []
            for raw in tok.encode_all(b.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u4").tolist()
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(tok.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tok.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
