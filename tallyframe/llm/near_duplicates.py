"""Near-duplicate documents by a multi-index Hamming join of b-bit minhash signatures.

A document is the set of its five-word shingles. Equal sets are first folded into
one representative each. A representative's signature is about 63 minimum hashes, 16 bits
of each kept. The signature is split into chunks of a few symbols, as many as the similarity asks for, and a
chunk is indexed once with each symbol left out: by pigeonhole, two signatures whose distance, in
symbols, is less than twice the number of chunks agree in some chunk up to one symbol, so they meet in some
bucket for certain; a pair just at the wanted similarity misses every bucket with probability under ``MISS``.
Signatures only make pairs meet: no pair that meets is refuted by them. Pairs are never expanded within a bucket:

1. every representative is confirmed, on full sets, against the leader (smallest id)
   that it shares most buckets with, and the links give components;
2. a few rounds join components that share a bucket through one confirmed pair each;
3. only buckets that still hold several components are looked at again. Those with the same
   largest component are one cluster; in it, members outside that component are held against all
   others of other components, each pair once, within the ratio of sizes, and confirmed on full sets.
   In a cluster of more than ``FEW`` members a member is known by its difference: the shingles that
   it and the cluster's pivot do not share. Two sets have as many shingles of their own as their differences have, so
   similar ones share a part of their differences that follows from the sizes, and meet in one of the rarest
   elements of both (prefix filter); those similar by sizes alone are each similar to the member with the most
   room. So members meet by what sets them apart from the group, and not by what all of the group share.
   Elements with many members are dealt, in squares, to many tasks.

Every pair that meets in a bucket is so either confirmed, refuted, or already connected.

Most pairs are refuted before any text is read, and exactly: an odd sketch holds, for each of
512 classes of shingle hashes, whether the set has an odd number of them. Two sketches differ in no more
places than the sets have shingles of their own, and sets of n and m shingles are similar enough only
with ``(100 + percent) * own <= (100 - percent) * (n + m)``. No pair that full sets confirm is lost to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices, uncollected
from .graph import connected_components
from .scratch import Scratch
from .words import mix, window_hashes, word_hashes

#: Minimum hashes computed, as far as whole chunks go, and the longs that hold their 16-bit symbols.
MOST_HASHES, LONGS = 63, 16
#: Chance, at most, that a pair just at the wanted similarity meets in no bucket.
MISS = 3e-5
#: Members that meet under one key in one side of a square.
SQUARE = 2048
#: Members of a cluster up to which all of them meet: so many pairs of each at most.
FEW = 64
#: Rounds that join components through single pairs before all pairs between components are looked at.
ROUNDS = 3
#: Representatives that one task puts in buckets: it groups over sixty keys of each, in about 100 bytes of its heap a key.
INDEX_ROWS = 10_000
#: Ids up to which the set of needed documents is broadcast: 8 bytes each.
BROADCAST_IDS = 200_000
_SIGNATURE = [f"s{k}" for k in range(LONGS)]
#: Classes of the odd sketch, as a power of two, and the longs that hold it.
ODD_BITS = 9
ODD_LONGS = 2**ODD_BITS // 64
_ODD = [f"o{k}" for k in range(ODD_LONGS)]
_RNG = np.random.default_rng(20_240_517)
_MULTIPLY = _RNG.integers(0, 2**63, MOST_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, MOST_HASHES, dtype=np.uint64)
_PLACES = _RNG.integers(0, 2**63, MOST_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def layout(percent: int) -> tuple[int, int]:
    """Chunks and symbols in each: the longest chunks with which a pair at the similarity is missed seldom enough."""
    same = percent / 100
    for symbols in range(MOST_HASHES, 1, -1):
        chunks = MOST_HASHES // symbols
        meets = same**symbols + symbols * same ** (symbols - 1) * (1 - same)
        if (1 - meets) ** chunks <= MISS:
            return chunks, symbols
    return MOST_HASHES // 2, 2


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer words, the whole sequence as one."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        return mix(window_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(hashes, width))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The 16-bit symbols of every non-empty set, one row each."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), MOST_HASHES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(MOST_HASHES):
            least = np.minimum.reduceat((x + _ADD[k]) * _MULTIPLY[k], starts)
            out[:, k] = (least >> np.uint64(12)) & np.uint64(0xFFFF)
    return out


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of longs each: the parity of every class of a set's hashes. Distinct elements are assumed."""
    rows = np.repeat(np.arange(len(sets)) << ODD_BITS, [len(s) for s in sets])
    classes = (np.concatenate(sets) >> np.uint64(64 - ODD_BITS)).astype(np.int64)
    counts = np.bincount(rows + classes, minlength=len(sets) << ODD_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(sets), -1), axis=1).view("<i8")


def bucket_keys(symbols: np.ndarray, chunks: int, size: int) -> np.ndarray:
    """Keys of every chunk with each symbol left out."""
    with np.errstate(over="ignore"):
        parts = symbols[:, : chunks * size].reshape(-1, chunks, size).astype(np.uint64) * _PLACES[:size]
        left_out = parts.sum(axis=2, keepdims=True, dtype=np.uint64) - parts
        return mix(left_out.reshape(-1, chunks * size) + np.arange(1, chunks * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketch(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles``, a 128-bit digest of the set, the signature and the odd sketch as longs."""

    def run(batches):
        for b in slices(batches):
            with uncollected():
                sets = [shingles(t or "", width) for t in b.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            symbols = np.zeros((len(sets), LONGS * 4), "<u2")
            odd = np.zeros((len(sets), ODD_LONGS), "<i8")
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                odd[full] = odd_sketches([sets[i] for i in full])
                symbols[full, :MOST_HASHES] = signatures([sets[i] for i in full])
            longs = symbols.view("<i8")
            columns = [b.column(0), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array([(d >> at & 2**64 - 1) - 2**63 for d in digests], pa.int64()) for at in (0, 64)]
            columns += [pa.array(np.ascontiguousarray(c), pa.int64()) for c in (*longs.T, *odd.T)]
            yield pa.record_batch(columns, names)

    names = ["doc_id", "n_shingles", "d0", "d1", *_SIGNATURE, *_ODD]
    schema = ", ".join(f"{c} bigint" for c in names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _index(reps: DataFrame, percent: int) -> DataFrame:
    """``key, rep``: every representative under each of its bucket keys."""
    chunks, size = layout(percent)
    tasks = -(-reps.count() // INDEX_ROWS) or 1

    def run(batches):
        for b in slices(batches, 2048):
            longs = np.column_stack([b.column(1 + k).to_numpy() for k in range(LONGS)]).astype("<i8")
            keys = bucket_keys(np.ascontiguousarray(longs).view("<u2"), chunks, size)
            ids = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "rep"])

    return reps.select("rep", *_SIGNATURE).repartition(tasks, "rep").mapInArrow(run, "key bigint, rep bigint")


def _sides(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``text_a, text_b`` of their members ``a, b``, sorted by ``b``."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    few = needed.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(needed) if few else needed, "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough."""
    sides = _sides(docs, pairs.select("a", "b"))

    def run(batches):
        last, kept = None, np.empty(0, np.uint64)
        for batch in slices(batches, 128):
            ok = []
            for b, ta, tb in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if b != last:  # rows arrive sorted by b
                    last, kept = b, shingles(tb or "", width)
                mine = shingles(ta or "", width)
                both = len(np.intersect1d(mine, kept, assume_unique=True))
                ok.append(100 * both >= percent * (len(mine) + len(kept) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _inside(members: DataFrame, found: DataFrame) -> DataFrame:
    """``key, rep, comp``: members with the component that they are in so far."""
    return members.join(found, members["rep"] == found["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))


def _differences(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """``major, a, differs``: the hashes that only one of the sets of ``a`` and ``b`` has, once for each ``major, a``."""

    def run(batches):
        last, pivot = None, np.empty(0, np.uint64)
        for batch in slices(batches, 128):
            differs = []
            for b, ta, tb in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if b != last:  # rows arrive sorted by b
                    last, pivot = b, shingles(tb or "", width)
                differs.append(np.setxor1d(shingles(ta or "", width), pivot, assume_unique=True).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(differs, pa.list_(pa.int64()))], ["major", "a", "differs"])

    found = _sides(docs, pairs.select("major", "a", "b")).select("major", "a", "b", "text_a", "text_b")
    # An id that is repeated has a row for each time.
    return found.mapInArrow(run, "major bigint, a bigint, differs array<bigint>").dropDuplicates(["major", "a"])


def _meetings(docs: DataFrame, clusters: DataFrame, scratch: Scratch, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where members of ``clusters`` (``major, rep, comp, met, n_shingles``) meet.

    Returns strays and all members, each as ``key, rep, comp, major`` under the keys in which they meet, and pairs
    ``a, b, ca, cb`` that are similar by sizes alone.
    """
    sizes = scratch.keep(clusters.groupBy("major").agg(F.count("*").alias("n")), "sizes")
    where = ["rep", "comp", "major"]
    small = clusters.join(sizes.filter(F.col("n") <= FEW), "major").select(F.xxhash64("major").alias("key"), *where)
    strays, everyone = small.filter("comp <> major"), small
    sizes = sizes.filter(F.col("n") > FEW)
    if sizes.isEmpty():
        nothing = clusters.filter("1 = 0").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("comp").alias("ca"), F.col("comp").alias("cb"))
        return strays, everyone, nothing
    large = scratch.keep(clusters.join(sizes, "major"), "large")
    central = F.struct(F.col("comp") == F.col("major"), "met", -F.col("rep"))
    pivots = large.groupBy("major").agg(F.max_by("rep", central).alias("b"), F.max_by("n_shingles", central).alias("size"))
    # Room: what a set may differ by, less what it does, in units of 1 / (100 + percent). Sets with room together are similar enough for certain.
    pivots = pivots.select("major", "b", F.greatest(F.lit(1), F.floor((100 - percent) * F.col("size") / 4)).alias("unit"))
    pairs = large.select("major", F.col("rep").alias("a"), "comp", "n_shingles").join(pivots, "major")
    own = _differences(docs, pairs, width).join(pairs, ["major", "a"]).withColumn("room", (100 - percent) * F.col("n_shingles") - (100 + percent) * F.size("differs"))
    own = own.select("major", F.col("a").alias("rep"), "comp", "room", "unit", F.ceil(F.col("room") / F.col("unit")).alias("class"), "differs")
    own = scratch.keep(own, "differences")
    most = own.groupBy("major").agg(F.max_by(F.struct("rep", "comp", "room"), F.struct("room", -F.col("rep"))).alias("top"))
    sure = own.join(most, "major").filter((F.col("comp") != F.col("top.comp")) & (F.col("room") + F.col("top.room") >= 0))
    sure = sure.select(F.col("rep").alias("a"), F.col("top.rep").alias("b"), F.col("comp").alias("ca"), F.col("top.comp").alias("cb"))
    # Elements of one member alone are its rarest, and no other has them.
    each = own.select("major", "rep", F.explode("differs").alias("element"))
    often = each.groupBy("major", "element").agg(F.count("*").alias("n")).filter("n > 1")
    rarest = each.join(often, ["major", "element"]).groupBy("major", "rep").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("shared"))
    rarest = scratch.keep(own.drop("differs").join(rarest, ["major", "rep"]), "rarest")

    def keyed(rows: DataFrame, partners: DataFrame, stray: str, other: str) -> DataFrame:
        """Keys of the rarest elements among which a similar one of a class has one at least, for each class whose members have enough to share."""
        partners = partners.groupBy("major", F.col("class").alias("partner")).agg(F.max(F.size("shared")).alias("most"))
        rows = rows.join(partners, "major")
        least = F.greatest(F.lit(1), F.ceil(-(F.col("class") + F.col("partner")) * F.col("unit") / (2 * (100 + percent))))
        rows = rows.withColumn("least", least).filter((F.col("least") <= F.col("most")) & (F.col("least") <= F.size("shared")))
        rows = rows.withColumn("take", (F.size("shared") - F.col("least") + 1).cast("int"))
        rows = rows.withColumn("element", F.explode(F.slice("shared", F.lit(1), F.col("take"))))
        return rows.select(F.xxhash64("major", stray, other, "element.element").alias("key"), *where)

    apart = rarest.filter("comp <> major")
    return strays.union(keyed(apart, rarest, "class", "partner")), everyone.union(keyed(rarest, apart, "partner", "class")), sure


def _merge(docs: DataFrame, pairs: DataFrame, found: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame | None:
    """Components joined through those ``pairs`` (``a, b`` in components ``ca, cb``) that full sets confirm; None if there are none."""
    bridges = _confirm(docs, pairs, width, percent).join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    bridges = scratch.keep(bridges.distinct(), "links")
    if bridges.isEmpty():
        return None
    joined = connected_components(bridges, scratch)
    joined = scratch.keep(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "components")
    moved = found.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    # Representatives without a link until now.
    alone = joined.select(F.col("component").alias("node"), F.col("top").alias("component")).join(found, "node", "left_anti")
    return scratch.keep(moved.union(alone), "merged")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 85) -> DataFrame:
    """Components of documents whose shingle sets have ``100 * intersection >= percent * union``.

    Returns ``doc_id, n_shingles, component_id, kept``, a row for each row with an id. Null, empty and
    blank texts are empty sets, linked with nothing and kept. Rows without an id cannot be
    named in a component and are left out. Copies, however many, cost one row each in the index. Rows
    that repeat an id and its text are one document, returned as often as it occurs. Extra columns
    are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    sketch = scratch.keep(_sketch(docs, width), "sketch")
    same = ["n_shingles", "d0", "d1"]
    reps = sketch.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in (*_SIGNATURE, *_ODD)])
    reps = scratch.keep(reps, "reps")
    # Different sets this small cannot be similar enough: k shared of k + 1 at best.
    least = -(-percent // (100 - percent))
    keys = _index(reps.filter(F.col("n_shingles") >= least), percent)
    shared = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead")
    members = scratch.keep(keys.join(shared, "key"), "members")

    sig = reps.select("rep", "n_shingles", *_SIGNATURE, *_ODD)
    other = sig.select(*[F.col(c).alias(f"o_{c}") for c in sig.columns])
    bits, odd = (sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in longs), F.lit(0)) for longs in (_SIGNATURE, _ODD))
    small, large = F.least("n_shingles", "o_n_shingles"), F.greatest("n_shingles", "o_n_shingles")
    possible = (100 + percent) * odd <= (100 - percent) * (small + large)
    near = (100 * small >= percent * large) & possible

    lead = members.filter("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("n"))
    lead = lead.groupBy("rep").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("o_rep"))
    first = lead.join(sig, "rep").join(other, "o_rep").filter(near).select(F.col("rep").alias("a"), F.col("o_rep").alias("b"))
    linked = scratch.keep(_confirm(docs, scratch.keep(first, "pairs"), width, percent), "links")
    found = scratch.keep(connected_components(linked, scratch), "components")

    # Components that share a bucket are joined through one pair each, nearest first, as long as that links any.
    for _ in range(ROUNDS):
        inside = scratch.keep(_inside(members, found), "inside")
        groups = inside.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
        major = groups.groupBy("key").agg(F.max_by(F.struct("comp", "rep"), F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1")
        cross = groups.join(major, "key").filter(F.col("comp") != F.col("m.comp"))
        cross = cross.select("rep", F.col("m.rep").alias("o_rep"), F.col("comp").alias("ca"), F.col("m.comp").alias("cb")).distinct()
        cross = cross.join(sig, "rep").join(other, "o_rep").filter(near).groupBy("ca", "cb").agg(F.min_by(F.struct("rep", "o_rep"), bits).alias("p"))
        cross = scratch.keep(cross.select(F.col("p.rep").alias("a"), F.col("p.o_rep").alias("b"), "ca", "cb"), "pairs")
        merged = _merge(docs, cross, found, scratch, width, percent)
        if merged is None:
            break
        found = merged

    inside = scratch.keep(_inside(members, found), "inside")
    sizes = inside.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("major"))
    mixed = mixed.filter("comps > 1").select("key", "major")
    clusters = inside.join(mixed, "key").groupBy("major", "rep", "comp").agg(F.count("*").alias("met"))
    clusters = scratch.keep(clusters.join(reps.select("rep", "n_shingles"), "rep"), "clusters")
    strays, everyone, sure = _meetings(docs, clusters, scratch, width, percent)
    # A key of many members is a square of parts, each of bounded size and met by itself.
    sides = strays.select("key", F.lit(1).alias("s"), F.lit(0).alias("e")).union(everyone.select("key", F.lit(0), F.lit(1)))
    parts = sides.groupBy("key").agg(F.sum("s").alias("s"), F.sum("e").alias("e")).filter("s > 0 and e > 0")
    parts = scratch.keep(parts.select("key", F.ceil((F.col("s") + F.col("e")) / SQUARE).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    facts = ["n_shingles", *_ODD]
    all_ = everyone.join(parts, "key").join(reps.select("rep", *facts), "rep").select("key", part.alias("row"), every.alias("col"), *[F.col(c).alias(f"o_{c}") for c in ("rep", "comp", *facts)])
    stray = strays.join(parts, "key").join(reps.select("rep", *facts), "rep").select("key", part.alias("col"), every.alias("row"), "rep", "comp", "major", *facts)
    once = (F.col("o_comp") == F.col("major")) | (F.col("rep") < F.col("o_rep"))
    second = (
        stray.join(all_.hint("merge"), ["key", "row", "col"]).filter((F.col("comp") != F.col("o_comp")) & once & near)
        .select(F.col("rep").alias("a"), F.col("o_rep").alias("b"), F.col("comp").alias("ca"), F.col("o_comp").alias("cb"))
        .union(sure).distinct()
    )
    second = scratch.keep(second, "pairs")
    merged = _merge(docs, second, found, scratch, width, percent)
    merged = found if merged is None else merged
    classes = reps.select(*same, "rep").join(merged, F.col("rep") == F.col("node"), "left")
    classes = classes.select(*same, F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", *same).join(classes, same, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def near_duplicates_sql() -> str:
    """DuckDB SQL of :func:`near_duplicates` at its defaults: all pairs that share a shingle, counted exactly."""
    return r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id WHERE d.doc_id IS NOT NULL"""
