"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Centroids come in two levels, fitted on a bounded sample: cells of about a block of vectors each, and lists within
a cell, whose number grows with the square root of the table; residuals to a list's centroid are product-quantised.
Every vector is indexed. A cell is cut into blocks of bounded size, so a third of all vectors in one cell is many
tasks. A query goes to the cells that hold one of the lists of largest inner product with it, once to each
block; there it skips the lists it does not visit, scores the codes of the others through its table of inner
products (asymmetric: the query is not quantised), and reranks the best of them by the exact inner product. Blocks and
queries meet in one sorted stream: a task holds one block and a slice of queries, however many queries there are.

The number of lists visited and the reranking depth are set by a bounded number of the queries asked, whose true nearest
are found by brute force over the whole table: these tell what vectors that the fit did not see, queries unlike the
table, or a few very long vectors ask for, which held-back vectors of the sample do not. Where those ask for more, that counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Vectors in one block of a cell, about.
BLOCK_ROWS = 8192
#: Queries that are scored at a time.
QUERY_ROWS = 256
#: Numbers in a piece of vectors to rerank.
PIECE = 4_000_000


def unit(q: np.ndarray) -> np.ndarray:
    """Queries of length one, which order vectors alike: long and short ones stay within single precision."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return (q / np.sqrt((q**2).sum(axis=1, keepdims=True))).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm; empty cells take points far from their centre."""
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (centres**2).sum(1) - 2 * x @ centres.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        filled = n > 0
        starts = (np.cumsum(n) - n)[filled]
        centres[filled] = np.add.reduceat(x[order], starts, axis=0) / n[filled, None]
        if not filled.all():
            centres[~filled] = x[np.argsort(-d[np.arange(len(x)), at])[: int((~filled).sum())]]
    return centres


@dataclass
class Index:
    """Cells, lists with the cell each lies in (ordered by cell), residual codebooks, one per part of the vector, the search widths and, once known, how many vectors each list holds."""

    cells: np.ndarray
    lists: np.ndarray
    cell_of: np.ndarray
    books: list[np.ndarray]
    probes: int = 1
    depth: int = 100
    sizes: np.ndarray | None = None

    @property
    def parts(self) -> list[slice]:
        """The dimensions of each codebook."""
        at = np.cumsum([0, *[b.shape[1] for b in self.books]]).tolist()
        return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """List of each vector: the nearest within the nearest cell."""
        cell = ((self.cells**2).sum(1) - 2 * x @ self.cells.T).argmin(1)
        out = np.empty(len(x), np.int64)
        first = np.searchsorted(self.cell_of, np.arange(len(self.cells) + 1))
        for c in np.unique(cell).tolist():
            mine, own = np.flatnonzero(cell == c), self.lists[first[c] : first[c + 1]]
            out[mine] = first[c] + ((own**2).sum(1) - 2 * x[mine] @ own.T).argmin(1)
        return out

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Codes of the residuals."""
        rest = x - self.lists[lists]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, (book, dims) in enumerate(zip(self.books, self.parts, strict=True)):
            codes[:, m] = ((book**2).sum(1) - 2 * rest[:, dims] @ book.T).argmin(1)
        return codes

    def cut(self, q: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of queries with all lists, and the least one of a list that a query visits, so that it meets over ``k`` vectors if there are any."""
        near = q @ self.lists.T
        least = -np.partition(-near, self.probes - 1, axis=1)[:, self.probes - 1]
        if self.sizes is not None:
            for r in np.flatnonzero((near >= least[:, None]) @ self.sizes <= k).tolist():
                order = np.argsort(-near[r], kind="stable")
                least[r] = near[r, order[min(np.searchsorted(np.cumsum(self.sizes[order]), k, "right"), len(order) - 1)]]
        return near, least

    def rough(self, q: np.ndarray, near: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of coded vectors by each query's table, on top of ``near`` of their lists; a column per query, so that a look-up copies a row."""
        out = near[lists]
        tables = [np.ascontiguousarray(book @ q[:, dims].T) for book, dims in zip(self.books, self.parts, strict=True)]
        for at in range(0, len(lists), 1024):
            some, own = out[at : at + 1024], codes[at : at + 1024]
            for m, table in enumerate(tables):
                some += table[own[:, m]]
        return out

    def widen(self, q: np.ndarray, query: np.ndarray, lists: np.ndarray, codes: np.ndarray, at: np.ndarray, sample: np.ndarray, *, recall: float, k: int, every: bool) -> None:
        """Set the search widths so that queries ``q`` reach ``recall``, half of the loss left to each width.

        ``query, lists, codes``: for each vector wanted, whose it is, its list and codes. ``at, sample``: lists and codes of the sample.
        If these are not all queries (``every``), the mean has to reach it by a standard error more.
        """
        near = q @ self.lists.T
        place = np.empty(near.shape, int)
        np.put_along_axis(place, np.argsort(-near, axis=1, kind="stable"), np.broadcast_to(np.arange(near.shape[1]), near.shape), axis=1)
        reach = place[query, lists]
        ordered, wanted, goal = np.sort(reach), np.bincount(query, minlength=len(q)), 1 - (1 - recall) / 2
        for level in np.linspace(goal, 1, 26):
            self.probes = int(ordered[math.ceil(level * len(reach) - 1e-9) - 1]) + 1
            got = (np.bincount(query, reach < self.probes, len(q)) / wanted.clip(1))[wanted > 0]
            if got.mean() - (0 if every else got.std() / math.sqrt(len(got))) >= goal:
                break
        # How many of a block's vectors score above a wanted one by their codes, so that reranking still sees it.
        rough = self.rough(q, near.T, at, sample).T
        own = near[query, lists]
        for m, (book, dims) in enumerate(zip(self.books, self.parts, strict=True)):
            own += np.einsum("ij,ij->i", book[codes[:, m]], q[query][:, dims])
        cell = self.cell_of[at]
        in_sample = np.bincount(cell, minlength=len(self.cells))
        in_cell = in_sample if self.sizes is None else np.bincount(self.cell_of, self.sizes, len(self.cells))
        rows = np.minimum(in_cell, BLOCK_ROWS) / in_sample.clip(1)
        members = [np.flatnonzero(cell == c) for c in range(len(self.cells))]
        deep = [(rough[t, members[c]] > s).sum() * rows[c] for t, c, s in zip(query.tolist(), self.cell_of[lists].tolist(), own, strict=True)]
        self.depth = int(max(3 * k, np.quantile(deep, 0.99) * 1.25 + k))


def fit(sample: np.ndarray, total: int, *, parts: int = 16, recall: float = 0.95, k: int = 20, tests: int = 200, seed: int = 7) -> Index:
    """Fit on the sample's different vectors but for held-back queries, and widen the search until these reach ``recall`` in the sample."""
    rng = np.random.default_rng(seed)
    sample = np.unique(np.asarray(sample, np.float32), axis=0)
    held = rng.permutation(len(sample))[: min(tests, len(sample) // 5)]
    x = np.delete(sample, held, axis=0)
    dims = sample.shape[1]
    cells = kmeans(x, min(-(-total // BLOCK_ROWS), max(1, len(x) // 64)), rng)
    each = max(1, round(8 * math.sqrt(total) / len(cells)))
    at = ((cells**2).sum(1) - 2 * x @ cells.T).argmin(1)
    inside = [x[at == c] for c in range(len(cells))]
    lists = [kmeans(p, min(each, max(1, len(p) // 4)), rng, 6) if len(p) else cells[c : c + 1] for c, p in enumerate(inside)]
    index = Index(cells, np.concatenate(lists), np.repeat(np.arange(len(cells)), [len(p) for p in lists]), [])
    at = index.assign(x)
    rest = x - index.lists[at]
    edges = np.linspace(0, dims, min(parts, dims) + 1).astype(int)
    index.books = [kmeans(rest[:20_000, a:b], 256, rng, 6) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    index.probes = len(index.lists)
    if not len(held):
        index.depth = max(100, len(sample))
        return index
    codes, q = index.encode(x, at), sample[held]
    want = np.argsort(-(q @ x.T), axis=1)[:, : min(k, len(x))]
    query = np.repeat(np.arange(len(q)), want.shape[1])
    index.widen(q, query, at[want.ravel()], codes[want.ravel()], at, codes, recall=recall, k=k, every=False)
    return index


@dataclass
class Block:
    """The vectors of one block in order of their ids. Of equal vectors only the ``k + 1`` smallest ids can be among anyone's nearest."""

    ids: np.ndarray
    x: np.ndarray
    lists: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(index: Index, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, k: int) -> Block:
        """Copies beyond the ``k + 1`` smallest ids left out."""
        rows = np.ascontiguousarray(x + 0.0).view([("", x.dtype)] * x.shape[1]).ravel()
        order = np.lexsort((ids, np.unique(rows, return_inverse=True)[1].ravel()))
        same = rows[order]
        first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        nth = np.arange(len(ids)) - np.repeat(first, np.diff([*first, len(ids)]))
        keep = order[nth <= k]
        keep = keep[np.argsort(ids[keep], kind="stable")]
        return Block(ids[keep], x[keep], lists[keep], codes[keep])

    def search(self, index: Index, own: np.ndarray, q: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of queries, ids and exact scores of each query's best ``k`` here."""
        q32 = unit(q)
        here, place = np.unique(self.lists, return_inverse=True)
        near = index.lists[here] @ q32.T
        near[near < cut.astype(np.float32) - 1e-5] = -np.inf
        seen = np.flatnonzero((near > -np.inf).any(axis=1)[place])
        if not len(seen):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rough = index.rough(q32, near, place[seen], self.codes[seen])
        at = np.searchsorted(self.ids[seen], own).clip(max=len(seen) - 1)
        rough[at, np.arange(len(own))] = np.where(self.ids[seen][at] == own, -np.inf, rough[at, np.arange(len(own))])
        rough = np.ascontiguousarray(rough.T)
        depth = min(index.depth, rough.shape[1])
        least = -np.partition(-rough, depth - 1, axis=1)[:, depth - 1]
        rows, at = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
        at = seen[at]
        step = max(1, PIECE // q.shape[1])
        exact = np.concatenate([np.einsum("ij,ij->i", self.x[at[i : i + step]], q[rows[i : i + step]]) for i in range(0, len(at), step)])
        order = np.lexsort((self.ids[at], -exact, rows))
        rows, at, exact = rows[order], at[order], exact[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = nth < k
        return rows[best], self.ids[at[best]], exact[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, embedding array<double>`` of finite non-zero vectors of the commonest length, each id once: its lexicographically smallest vector."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))
    df = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    sizes = df.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    return df.filter(F.size("embedding") == (sizes.dims if sizes else -1)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _truth(ids: np.ndarray, q: np.ndarray, k: int):
    """The true ``k`` nearest of few queries among a task's vectors: places of queries, ids, scores, lists and codes."""

    def run(batches):
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32), np.empty(0, object)]
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(1).to_numpy()
            score = q @ _matrix(b.column(2)).T
            score[ids[:, None] == own] = -np.inf
            least = -np.partition(-score, min(k, b.num_rows) - 1, axis=1)[:, min(k, b.num_rows) - 1]
            rows, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            new = [rows, own[at], score[rows, at], b.column(3).to_numpy()[at], b.column(4).to_numpy(zero_copy_only=False)[at]]
            best = [np.concatenate(p) for p in zip(best, new, strict=True)]
            order = np.lexsort((best[1], -best[2], best[0]))
            order = order[np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order]) < k]
            best = [p[order] for p in best]
        yield pa.record_batch([pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2]), pa.array(best[3], pa.int32()), pa.array(best[4], pa.binary())], ["query", "id", "score", "list", "code"])

    return run


def _meet(index: Index, k: int):
    """Searches a stream sorted by cell, block and kind (a block's vectors before its queries)."""

    def run(batches):
        key, parts, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            where = np.column_stack([b.column(c).to_numpy() for c in range(3)])
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if key != (now := tuple(where[a, :2].tolist())):
                    key, parts, block = now, [], None
                run_ = b.slice(a, z - a)
                if where[a, 2] == 0:
                    codes = np.frombuffer(b"".join(run_.column(6).to_pylist()), np.uint8).reshape(z - a, -1)
                    parts.append((run_.column(3).to_numpy(), _matrix(run_.column(4)), run_.column(5).to_numpy(), codes))
                    continue
                if not parts and block is None:
                    continue
                if block is None:
                    block, parts = Block.of(index, *map(np.concatenate, zip(*parts, strict=True)), k), []
                for at in range(0, z - a, QUERY_ROWS):
                    some = run_.slice(at, QUERY_ROWS)
                    own = some.column(3).to_numpy()
                    rows, ids, scores = block.search(index, own, _matrix(some.column(4)), some.column(7).to_numpy(), k)
                    yield pa.record_batch([pa.array(own[rows]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    *,
    every: int = 20,
    k: int = 20,
    sample_rows: int = 30_000,
    recall: float = 0.95,
    tests: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` vectors of largest inner product for every row whose id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``, ties to the smaller id. Null ids, null, zero and non-finite vectors
    and such of another length than most (no inner product is defined for them) take no part; of rows that share an id the
    lexicographically smallest vector counts. At most ``sample_rows`` vectors, those of the smallest id hashes, are
    collected to fit the index, which bounds the number of lists at a quarter of that. At most ``tests`` queries, also those of the
    smallest hashes, are compared with every vector to set how far the others search. Vectors of any length are
    read whole. Extra columns are not read. An empty table gives no rows; fewer candidates than ``k`` are all returned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    base = scratch.keep(usable(vectors, id_col, vector_col), "vectors")
    total, most = base.agg(F.count("*"), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    asking = base.filter(F.col("vec_id") % every == 0)
    if not total or not (n_asking := asking.count()):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # The index is over vectors whose greatest component is one, within single precision.
    picked = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select(F.transform("embedding", lambda v: (v / most).cast("float")).alias("v"))
    sample = _matrix(picked.toArrow()["v"].combine_chunks())
    index = fit(sample, total, k=k, recall=recall)

    def put(batches):
        for b in batches:
            x = (_matrix(b.column(1)) / most).astype(np.float32)
            lists = index.assign(x)
            codes = index.encode(x, lists)
            yield pa.record_batch(
                [pa.array(index.cell_of[lists], pa.int32()), b.column(0), b.column(1), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                ["cell", "id", "vec", "list", "code"],
            )

    def ask(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERY_ROWS):
                some = b.slice(at, QUERY_ROWS)
                near, cut = index.cut(unit(_matrix(some.column(1))), k)
                first = np.searchsorted(index.cell_of, np.arange(len(index.cells)))
                rows, cells = np.nonzero(np.maximum.reduceat(near, first, axis=1) >= cut[:, None])
                pick = pa.array(rows)
                yield pa.record_batch([pa.array(cells, pa.int32()), some.column(0).take(pick), some.column(1).take(pick), pa.array(cut[rows].astype(float))], ["cell", "id", "vec", "cut"])

    indexed = scratch.keep(base.mapInArrow(put, "cell int, id bigint, vec array<double>, list int, code binary"), "index")
    # A number per list, a quarter of the sample at most.
    held = indexed.groupBy("list").agg(F.count("*").alias("n")).toPandas()
    index.sizes = np.bincount(held["list"], held["n"], len(index.lists))
    some = asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(tests).select("vec_id", "embedding").toArrow()
    q = _matrix(some["embedding"].combine_chunks())
    true = indexed.select("cell", "id", "vec", "list", "code").mapInArrow(_truth(some["vec_id"].to_numpy(), q, k), "query int, id bigint, score double, list int, code binary")
    true = true.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k).toPandas()
    if len(true):
        at, told = index.assign(sample), (index.probes, index.depth)
        codes = np.frombuffer(b"".join(true["code"]), np.uint8).reshape(len(true), -1)
        index.widen(unit(q), true["query"].to_numpy(), true["list"].to_numpy(), codes, at, index.encode(sample, at), recall=recall, k=k, every=n_asking <= tests)
        index.probes, index.depth = max(index.probes, told[0]), max(index.depth, told[1])
    # Bounded by the number of cells, a sixty-fourth of the sample at most.
    blocks = F.broadcast(indexed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    stored = indexed.join(blocks, "cell").select("cell", block, F.lit(0).alias("kind"), "id", "vec", "list", "code", F.lit(0.0).alias("cut"))
    asked = asking.mapInArrow(ask, "cell int, id bigint, vec array<double>, cut double").join(blocks, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "vec", F.lit(0).alias("list"), F.lit(None).cast("binary").alias("code"), "cut")
    stream = stored.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind", "id")
    found = stream.mapInArrow(_meet(index, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
