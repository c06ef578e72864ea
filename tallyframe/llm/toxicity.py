"""Toxic passages by maximum-scoring segments.

Fitting: words of a bounded sample of labelled documents, near copies once, and the prefixes of
words (compounds share them), get the log-odds of toxic against clean documents
under Dirichlet priors in proportion to their overall frequency. Scoring: each
word scores by its surest feature less a drift that makes ordinary text negative;
one linear scan yields every maximal-scoring segment. Chance segments' scores
follow an extreme-value law, so a segment counts by how far its scaled score
exceeds what text of that length would give, and a logistic fit on the labelled
sample turns the sum of these excesses into a probability.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices, uncollected
from .words import mix, window_hashes, word_hashes

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
#: Evidence beyond which more makes no difference.
MOST_EXCESS = 50.0
SEGMENT = "array<struct<start:int,end:int,score:double,excess:double>>"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word, and its prefixes marked by a hyphen; a word of prefix length counts as its own prefix too."""
    return [word, *[word[:k] + "-" for k in PREFIXES if k <= len(word)]]


@dataclass
class Model:
    """Scores of features and their lower confidence bounds, the drift, the extreme-value constants and the logistic fit."""

    score: dict[str, float]
    sure: dict[str, float]
    drift: float
    scale: float
    log_k: float
    bias: float
    slope: float

    def word_score(self, word: str) -> float:
        """Score of one word, less the drift: its own if it is known well, else that of its surest prefix."""
        if word in self.score:
            return self.score[word] - self.drift
        best = max((f for f in features_of(word) if f in self.score), key=self.sure.__getitem__, default=None)
        return (self.score[best] if best else 0.0) - self.drift

    def probability(self, excess: float) -> float:
        """Probability of the label at this sum of excesses, which the fit saw up to ``MOST_EXCESS``."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * min(excess, MOST_EXCESS)))))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in one linear scan.

    Candidates are kept on a stack with the sums left and right of each and a link to the nearest
    candidate with a lower left sum.
    """
    stack: list[list] = []  # start, end, sum before, sum through, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def segments(model: Model, scores: list[float]) -> list[tuple[int, int, float, float]]:
    """Significant segments: start and end word, score, and excess over chance."""
    chance = model.log_k + math.log(max(len(scores), 1))
    found = [(a, b, s, model.scale * s - chance) for a, b, s in maximal_segments(scores)]
    return [x for x in found if x[3] > 0]


def different(rows: list[tuple[str, int]], places: int = 8) -> list[tuple[str, int]]:
    """One of each group of near copies: texts that share half of their minimum hashes over five-word
    windows with one already taken would count the same words again."""
    taken: set[tuple[int, int]] = set()
    out = []
    for text, y in rows:
        words = word_hashes(text.encode().lower().split())
        windows = window_hashes(words, 5) if len(words) >= 5 else mix(words.sum(keepdims=True))
        mins = [(k, int(mix(windows + np.uint64(k)).min())) for k in range(places)]
        if sum(m in taken for m in mins) * 2 < places:
            out.append((text, y))
            taken.update(mins)
    return out


def fit(texts: list[str], toxic: list[int], *, prior: float = 0.1, least_sure: float = 1.3, drift: float = 0.2, known: int = 20) -> Model | None:
    """Fit on labelled texts, each different text once; None unless both labels occur."""
    rows = different([(t, y) for t, y in zip(texts, toxic, strict=True) if t])
    n = [sum(y == c for _, y in rows) for c in (0, 1)]
    if not all(n):
        return None
    seen = (Counter(), Counter())
    with uncollected():
        for text, y in rows:
            seen[y].update({f for w in set(words_of(text)) for f in features_of(w)})
    score, sure = {}, {}
    for f, pos in seen[1].items():
        neg = seen[0].get(f, 0)
        if pos + neg >= known and f[-1] != "-":
            score[f], sure[f] = 0.0, 0.0  # speaks for itself, whatever its prefixes say
        a1, a0 = (0.01 + prior * (pos + neg) * k / sum(n) for k in (n[1], n[0]))
        odds = math.log((pos + a1) / (n[1] + 1 + 2 * a1 - pos)) - math.log((neg + a0) / (n[0] + 1 + 2 * a0 - neg))
        surely = odds - 1.64 * math.sqrt(1 / (pos + a1) + 1 / (neg + a0))
        if surely >= least_sure and pos >= 4:
            score[f], sure[f] = odds, surely
    model = Model(score, sure, drift, 1.0, 0.0, 0.0, 1.0)
    memo = functools.cache(model.word_score)
    scored = [(list(map(memo, words_of(t))), y) for t, y in rows]
    model.scale = _scale(Counter(round(s, 2) for ss, y in scored if not y for s in ss), [v - drift for v in score.values() if v])
    tops = [(model.scale * max((s for *_, s in maximal_segments(ss)), default=0.0), len(ss)) for ss, y in scored if not y and ss]
    chance = [top - math.log(m) for top, m in tops if top > 0]
    model.log_k = float(np.mean(chance)) - 0.5772 if len(chance) >= 20 else 0.0
    x = np.array([sum(s[3] for s in segments(model, ss)) for ss, _ in scored])
    model.bias, model.slope = _logistic(x, np.array([y for _, y in scored], float))
    return model


def _scale(background: Counter, scores: list[float]) -> float:
    """The positive root of E[exp(scale * score)] = 1 over clean text, with half a word of each score the model can give."""
    value = np.array([*background, *scores])
    weight = np.array([*background.values(), *[0.5 / max(len(scores), 1)] * len(scores)], float)
    weight /= weight.sum()
    if not (value > 0).any() or (weight * value).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    excess = lambda k: float((weight * np.exp(np.minimum(k * value, 500))).sum()) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Bias and slope by damped Newton steps on squashed evidence."""
    a = np.column_stack([np.ones(len(x)), np.minimum(x, MOST_EXCESS)])
    w = np.array([math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0))


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text, mod 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2000, clean_rows: int = 4000, chars: int = 40_000_000) -> Model | None:
    """Fit on at most so many labelled rows of either kind, those of the smallest id hashes, and so many characters.

    Either kind takes its share of the characters in that order, and what would not fit any more is left out of
    the fit; both bounds together are what the driver holds. Held-out rows, null ids and null labels are left out. An
    id that has several labels or texts counts with the least of each.
    """
    spark = docs.sparkSession
    usable = labels.filter(~held_out("doc_id") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    pick = lambda y, n: usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = pick(1, toxic_rows).unionByName(pick(0, clean_rows))
    sizes = docs.select("doc_id", F.length("text").alias("n")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n"))
    left = {1: chars * toxic_rows // (toxic_rows + clean_rows), 0: chars * clean_rows // (toxic_rows + clean_rows)}
    taken = []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n is not None and r.n <= left[int(r.toxic)]:
            left[int(r.toxic)] -= r.n
            taken.append((r.doc_id, int(r.toxic)))
    chosen = F.broadcast(spark.createDataFrame(taken, "doc_id bigint, toxic int"))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = texts.orderBy("doc_id").collect()
    return fit([r.text or "" for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted, segments`` of every whole text.

    Null and empty texts have no segments and get the lowest score, as does everything
    where no model could be fitted. Texts of any length are read whole. Repeated rows are scored once each; columns besides ``doc_id`` and
    ``text`` are not read; an empty table gives no rows.
    """

    def run(batches):
        memo = functools.lru_cache(200_000)(model.word_score) if model else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("excess", pa.float64())]))
        for b in slices(batches):
            found, scores = [], []
            with uncollected():
                for text in b.column(1).to_pylist():
                    got = segments(model, list(map(memo, words_of(text)))) if model and text else []
                    found.append([{"start": a, "end": e, "score": s, "excess": x} for a, e, s, x in got])
                    scores.append(model.probability(sum(x for *_, x in got)) if model else 0.0)
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "segments"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, score double, segments {SEGMENT}")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text is not scored toxic (score under 0.5).

    Every row is judged for itself, repeated ones too; null and empty texts stay, and all rows where no model could
    be fitted. An empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches):
        memo = functools.lru_cache(200_000)(model.word_score) if model else None
        for b in slices(batches):
            with uncollected():
                ok = [not (model and t) or model.probability(sum(x for *_, x in segments(model, list(map(memo, words_of(t)))))) < 0.5 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
