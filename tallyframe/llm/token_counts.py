"""Token counts by the whole-token shortcut.

Before counting, a worker proves for every string of the vocabulary whether it,
standing alone as a pre-token, merges into exactly its own single token: the
string must be one match of the pattern and its merges must end in one id. A
pre-token in that proven set counts one without merging; only the others are
merged. Words are remembered with their counts in two bounded generations.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


class Counter:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, tok: bpe.Codec):
        self.tok = tok
        self.whole = prove_whole(tok)
        self._memo: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Counts of the words; those of ordinary length are remembered."""
        if len(self._memo) > bpe.MEMO * 2:
            self._old, self._memo = self._memo, {}
        memo, old, whole = self._memo, self._old, self.whole
        missing = []
        for w in words:
            if w not in memo:
                if w in old:
                    memo[w] = old[w]
                elif w in whole:
                    memo[w] = 1
                else:
                    missing.append(w)
        cut = [(w, bpe.pieces_of(w, self.tok.pattern)) for w in missing]
        rest = [p for p in {p for _, ps in cut for p in ps} if p not in whole and p not in memo]
        merged = {p: len(x) // 4 for p, x in zip(rest, self.tok.encode_pieces([p.encode() for p in rest]), strict=True)}
        extra = {}
        for w, ps in cut:
            n = sum([1 if p in whole else merged[p] if p in merged else memo[p] for p in ps])
            (memo if len(w) <= bpe.MEMO_KEY else extra)[w] = n
        return extra

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        tok, cut, base, known = self.tok, [], [], set()
        for text in texts:
            parts = tok._special.split(text) if tok._special and tok._special.search(text) else [text]
            base.append(len(parts) // 2)
            words: list[str] = []
            for part in parts[::2]:
                words += (bpe.words_of(part) or tok.pattern.findall(part)) if part else []
            cut.append(words)
            known.update(words)
        extra = self._learn(known)
        memo = self._memo
        if extra:
            return [n + sum([memo[w] if w in memo else extra[w] for w in words]) for n, words in zip(base, cut, strict=True)]
        get = memo.__getitem__
        return [n + sum(map(get, words)) for n, words in zip(base, cut, strict=True)]


def prove_whole(tok: bpe.Codec) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and merge into exactly their own id."""
    texts = []
    for i, raw in enumerate(tok.tokens):
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue  # part of a character: never a whole pre-token
        if text and tok.pattern.fullmatch(text) and tok.pattern.findall(text) == [text] and text not in tok.special:
            texts.append((text, i))
    ids = tok.encode_pieces([t.encode() for t, _ in texts])
    return frozenset(t for (t, i), x in zip(texts, ids, strict=True) if x == i.to_bytes(4, "little"))


@functools.cache
def counter(vocabulary: str) -> Counter:
    """The worker's counter of a vocabulary."""
    return Counter(bpe.codec(vocabulary))


bpe.CACHES.append(counter)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Strings of special tokens inside a text count one token each, as the library's
    default has it. Null counts as empty (0 bytes, 0 tokens). Other columns are not
    read; repeated rows give a row each; an empty table gives none.
    """

    def run(batches):
        count = counter(vocabulary).count
        for b in bpe.slices(batches, 128, codecs=True):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n: list[int] = []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < bpe.BLOCK:
                    size += len(texts[end])
                    end += 1
                with bpe.uncollected():
                    n += count(texts[at:end])
                at = end
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = counted.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
