"""Bound-certified best-fit packing of token sequences.

Every document becomes its ids and a separator; longer ones are cut into full
sequences with the remainder as first piece. Pieces are dealt to packing groups
of bounded size. Each group packs by best-fit decreasing and computes a lower
bound on its bins from dual-feasible functions: a group that meets its bound is
certified and final. Groups with a gap give the documents of their unfilled bins
to an exchange; the exchanged documents are dealt anew, together, to fewer
groups and packed again, until what remains is certified or fits one group.
Pieces that fill a sequence alone never enter a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .scratch import Scratch

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, separator: int, remember: int = bpe.MEMO, rows: int = 1024) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""

    def run(batches: Iterable[pa.RecordBatch]):
        tok, end = bpe.codec(vocabulary), separator.to_bytes(4, "little")
        tok.remember = remember
        for b in bpe.slices(batches, rows, codecs=True):
            out: list[list[int]] = [[], [], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), tok.encode_all(b.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (at, to) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for column, value in zip(out, (doc, k, at, to - at, zlib.crc32(raw[4 * at : 4 * to])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions.

    ``u``: lengths over capacity - t count whole, those under t count nothing, others
    by their length, for every t up to half the capacity. ``f``: a length x counts
    ``ceil((k + 1) x / capacity) - 1`` of k parts, unless (k + 1) x is a multiple of the
    capacity, when it counts as it is.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total = counts * size
    below_n, below_sum = np.cumsum(counts), np.cumsum(total)
    t = np.arange(0, capacity // 2 + 1)
    over = below_n[-1] - below_n[capacity - t]
    inside = below_sum[capacity - t] - np.where(t > 0, below_sum[np.maximum(t - 1, 0)], 0)
    best = int(np.max(over + -(-inside // capacity)))
    for k in range(1, 21):
        x = (k + 1) * size
        # In units of 1 / (k * capacity), so that the sum stays an integer.
        value = np.where(x % capacity == 0, k * size, (x // capacity) * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length, and the room left in every bin.

    Longest first; each goes to the fullest bin that has room. The rooms in use are a bit set, so the
    fullest fit is its lowest bit from the length up.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    at_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = at_room[room].pop()
            if not at_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= size
        left[b] = room
        at_room[room].append(b)
        rooms |= 1 << room
    return bins, offsets, np.array(left, np.int64)


def _pack_group(capacity: int, first_sequence: int, last: bool):
    """Packs one group; what an uncertified group gives up has sequence_id null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        gap = len(left) - lower_bound(lengths, capacity)
        group = int(pdf["grp"].iloc[0])
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = pd.array(first_sequence + (group << 24) + bins, dtype="Int64")
        out["offset"] = pd.array(offsets, dtype="Int64")
        out["certified"] = gap == 0
        if gap > 0 and not last:
            out.loc[left[bins] > 0, ["sequence_id", "offset"]] = pd.NA
        return out

    return run


def pack(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    capacity: int = 2048,
    *,
    separator: int = 0,
    group_rows: int = 20_000,
    exchange_rows: int = 200_000,
    remember: int = bpe.MEMO,
    rows: int = 1024,
) -> DataFrame:
    """Pack the documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified``.

    Null and empty texts are one separator each. Texts of any length are cut whole. Repeated rows are packed once each; ties in
    length go by id and piece. Columns besides ``doc_id`` and ``text`` are not read. An empty table gives no rows.
    ``group_rows`` is what one task packs at first, and ``exchange_rows`` the most it ever does: the groups of an exchange
    grow fourfold up to that, and once an exchange among such groups leaves nine tenths of its rows without a certificate, their
    packing stands, uncertified. ``remember`` bounds the words
    a worker keeps the ids of, in two generations at about 160 bytes each, and ``rows`` the texts it cuts up at a time; results don't depend on them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.keep(pieces(docs, vocabulary, capacity, separator, remember, rows), "pieces")
    full = F.col("length") == capacity
    schema = PIECES + ", sequence_id bigint, offset bigint, certified boolean"
    # A full piece is a sequence by itself; its id needs no agreement with any other.
    done = [
        cut.filter(full)
        .withColumn("sequence_id", (F.lit(-1) - F.monotonically_increasing_id()).cast("long"))
        .withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))
    ]
    rest = cut.filter(~full)
    n, level, before = rest.count(), 0, None
    while n:
        size = min(group_rows * 4**level, exchange_rows) if level else group_rows
        stuck = before is not None and size == exchange_rows and 10 * n > 9 * before
        last = n <= size or stuck
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(-(-n // size))).cast("int"))
        packed = scratch.keep(dealt.groupBy("grp").applyInPandas(_pack_group(capacity, level << 56, last), schema), f"level{level}")
        done.append(packed.filter(F.col("sequence_id").isNotNull()))
        rest = packed.filter(F.col("sequence_id").isNull()).drop("sequence_id", "offset", "certified")
        before, n, level = n, 0 if last else rest.count(), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
