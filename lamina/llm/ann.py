"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees, searched through one queue.

Vectors get a further component sqrt(M - |v|^2), M the largest squared length, so that the largest inner product is the
smallest angle. Each tree has a random direction for each level and halves a bounded sample, level by level, at each
node's median; how deep follows from the number of vectors. Every vector is then indexed in one leaf of each tree.

A query's queue over all leaves of all trees is in order of its distance to a leaf, estimated from the margins on the way;
leaves leave the queue until they hold a given share of the index (copies in several trees counted each time). That share is measured: queries
of the sample are searched in the sample, and the share is the least that finds ``SURE`` of their true neighbours.
Clustered vectors need a small one; isotropic ones, which no index helps, most of the index. All vectors of those leaves
are ranked by exact inner products of the original vectors. A query whose leaves hold fewer than k ids, though there are
more, is compared with all vectors.

Neighbouring leaves of a tree are dealt to one cell, up to ``BLOCK`` vectors; a query goes once to each cell that holds
leaves of it, and meets those leaves' vectors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, written
from .embed_dedup import usable

TREES = 3
#: Vectors of a leaf, about, and levels at most (so that a leaf has some 16 vectors of the sample).
LEAF, DEEPEST = 192, 12
#: Vectors that fit the trees, about, and those of them whose neighbours fix the share; every vector is indexed.
SAMPLE, ASKED = 65_536, 256
#: Share of the sample's true neighbours that the measured share of the index finds.
SURE = 0.96
#: Vectors of a cell, about, and queries that are compared at once.
BLOCK, QUERIES = 16_384, 256


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


class Trees:
    """Complete binary trees: a direction for each level and a threshold for each inner node, in heap order."""

    def __init__(self, fit: np.ndarray, top: float, trees: int, depth: int, seed: int = 3) -> None:
        rng, x = np.random.default_rng(seed), self.lifted(fit, top)
        self.top, self.trees, self.depth = top, trees, depth
        self.a = rng.standard_normal((trees, depth, fit.shape[1] + 1))
        self.a /= np.sqrt((self.a * self.a).sum(axis=2, keepdims=True))
        self.t = np.zeros((trees, 2**depth - 1))
        for k in range(trees):
            p, node = x @ self.a[k].T, np.zeros(len(x), np.int64)
            for d in range(depth):
                order = np.lexsort((p[:, d], node))
                starts = np.flatnonzero(np.append(True, np.diff(node[order]) > 0)) if len(order) else np.zeros(0, np.int64)
                middle = (starts + np.append(starts[1:], len(order))) // 2
                self.t[k, node[order[starts]]] = p[order[middle], d]
                node = 2 * node + 1 + (p[:, d] >= self.t[k, node])

    @staticmethod
    def lifted(v: np.ndarray, top: float) -> np.ndarray:
        return np.hstack((v, np.sqrt(np.maximum(0, top - (v * v).sum(axis=1, keepdims=True)))))

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """(vectors, trees): leaf numbers over all trees."""
        x, out = self.lifted(v, self.top), np.empty((len(v), self.trees), np.int64)
        for k in range(self.trees):
            p, node = x @ self.a[k].T, np.zeros(len(v), np.int64)
            for d in range(self.depth):
                node = 2 * node + 1 + (p[:, d] >= self.t[k, node])
            out[:, k] = node - (2**self.depth - 1) + k * 2**self.depth
        return out

    def queue(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves of all trees), best first: by the sum of squares of what a query is on the wrong side by, on the way to a leaf."""
        x = np.hstack((q, np.zeros((len(q), 1))))
        off = np.empty((len(q), self.trees, 2**self.depth))
        for k in range(self.trees):
            p, far = x @ self.a[k].T, np.zeros((len(q), 1))
            for d in range(self.depth):
                m = p[:, d : d + 1] - self.t[k, 2**d - 1 : 2 ** (d + 1) - 1]
                far = np.stack((far + np.maximum(0, m) ** 2, far + np.minimum(0, m) ** 2), axis=2).reshape(len(q), -1)
            off[:, k] = far
        return np.argsort(off.reshape(len(q), -1), axis=1, kind="stable")


def measured_share(forest: Trees, x: np.ndarray, k: int, asked: int = ASKED, sure: float = SURE) -> float:
    """The share of the index (counted as ``search`` does) whose leaves hold ``sure`` of the true k nearest of ``asked`` vectors of ``x``."""
    leaf = forest.leaves(x)
    held = np.bincount(leaf.ravel(), minlength=forest.trees * 2**forest.depth)
    q, k = np.arange(0, len(x), max(1, -(-len(x) // asked))), min(k, len(x) - 1)
    if k < 1:
        return float(forest.trees)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = forest.queue(x[q])
    before = np.empty_like(order)
    np.put_along_axis(before, order, np.cumsum(held[order], axis=1) - held[order], axis=1)
    need = before[np.arange(len(q))[:, None, None], leaf[true]].min(axis=2)
    return float(np.quantile(need, sure, method="higher")) / len(x)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best, nearest first, ties to smaller ids, each id once, with their ranks from 1."""
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.ones(len(query), bool)
    first[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    query, vec, score = query[first], vec[first], score[first]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query)))) + 1
    top = rank <= k
    return query[top], vec[top], score[top], rank[top]


class _Cell:
    """The vectors of one cell, by leaf."""

    def __init__(self, tables: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(tables).combine_chunks()
        leaf = t.column("leaves").combine_chunks().flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        t = t.take(pa.array(order))
        self.x, ids = _matrix(t.column("v")), t.column("ids").combine_chunks()
        self.ids, self.many = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
        self.at = np.cumsum(self.many) - self.many
        names, starts = np.unique(leaf[order], return_index=True)
        self.span = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True), strict=True))

    def search(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        q, leaves = _matrix(batch.column("v")), batch.column("leaves")
        owner, leaf = np.repeat(np.arange(len(q)), leaves.value_lengths().to_numpy()), leaves.flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        owner, leaf = owner[order], leaf[order]
        names, starts = np.unique(leaf, return_index=True)
        asks, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, s, e in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True):
            lo, hi = self.span.get(name, (0, 0))
            if lo == hi:
                continue
            near, own = q[owner[s:e]] @ self.x[lo:hi].T, owner[s:e]
            if hi - lo > k + 1:
                edge = np.partition(near, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1 : hi - lo - k]
                i, j = np.nonzero(near >= edge - 1e-9 * (1 + np.abs(edge)))
            else:
                i, j = np.nonzero(np.ones_like(near, bool))
            asks.append(own[i])
            rows.append(lo + j)
        i, j = np.concatenate(asks), np.concatenate(rows)
        score = np.empty(len(i))
        for c in range(0, len(i), 1 << 15):
            score[c : c + (1 << 15)] = (q[i[c : c + (1 << 15)]] * self.x[j[c : c + (1 << 15)]]).sum(axis=1)
        n = self.many[j]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[j], n)
        me, vec, score = batch.column("key").to_numpy()[np.repeat(i, n)], self.ids[each], np.repeat(score, n)
        other = vec != me
        return _lists(*best(me[other], vec[other], score[other], k)[:3])


def _lists(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    at = pa.array(np.append(starts, len(query)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(query[starts]), pa.ListArray.from_arrays(at, pa.array(score)), pa.ListArray.from_arrays(at, pa.array(vec))], ["query_id", "score", "vec"])


def _search(k: int):
    """Rows by cell, vectors before queries: holds one cell's vectors, and lets its queries pass by."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, cell = None, [], None
        for b in batches:
            cells, asks = b.column("cell").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1]))) if b.num_rows else []
            for s, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                own = b.slice(int(s), int(e - s))
                if cells[s] != now:
                    now, gathered, cell = cells[s], [], None
                if not asks[s]:
                    gathered.append(own)
                elif gathered or cell is not None:
                    if cell is None:
                        cell, gathered = _Cell(gathered), []
                    for i in range(0, own.num_rows, QUERIES):
                        yield cell.search(own.slice(i, QUERIES), k)

    return work


def _merge(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in runs(batches, ["query_id"]):
            score, vec = (t.column(c).combine_chunks() for c in ("score", "vec"))
            query = np.repeat(t.column("query_id").to_numpy(), score.value_lengths().to_numpy())
            query, vec, score, rank = best(query, vec.flatten().to_numpy(), score.flatten().to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(rank.astype(np.int32)), pa.array(vec), pa.array(score)], ["query_id", "rank", "vec_id", "score"])

    return work


def cells_of(held: np.ndarray, trees: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first cell and its number of cells: neighbouring leaves of a tree share one up to ``block`` vectors, a larger leaf has several."""
    first, several, cell = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0
    for tree in np.split(np.arange(len(held)), trees):
        room = 0
        for leaf in tree.tolist():
            n = int(held[leaf])
            if n > block:
                several[leaf] = -(-n // block)
                first[leaf], room = cell + 1, 0
                cell += int(several[leaf])
            else:
                if n > room:
                    cell, room = cell + 1, block
                first[leaf] = cell
                room -= n
    return first, several


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = TREES, depth: int | None = None, share: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest of ``vectors`` found, by inner product.

    Vectors without id, null, empty, zero or with null or non-finite components take no part. Vectors of different
    lengths have no inner product; each length is an index of its own. A vec_id names one query; rows with a query's own
    id are no candidates of it. Repeated rows count once. Equal vectors are indexed once, with their k + 1 smallest ids:
    no query can want more. ``depth`` and ``share`` are set by the number of vectors and by measurement if not given. An
    empty table gives an empty result; other columns play no part.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vector in vectors.columns and vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))

    rows = clean(vectors).withColumn("node", F.xxhash64("v"))
    ids = rows.select("node", "vec_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(f"r <= {k + 1}")
    ids = ids.groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = written(rows.groupBy("node").agg(F.first("v").alias("v")).join(ids, "node"), "vectors")
    asked = written(clean(queries).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v")), "queries")
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    lengths = index.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(squared).alias("top")).orderBy("dim").collect()  # a row a length
    found = [_indexed(index.where(F.size("v") == r["dim"]), asked.where(F.size("v") == r["dim"]), r["dim"], r["n"], r["top"], k, trees, depth, share, block, kind) for r in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _indexed(index: DataFrame, asked: DataFrame, dim: int, n: int, top: float, k: int, trees: int, depth: int | None, share: float | None, block: int, kind: str) -> DataFrame:
    """``search`` among vectors of one length."""
    fit = index.where(F.pmod("node", F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).orderBy("node").select("v").limit(2 * SAMPLE).toArrow()
    x = _matrix(fit.column("v")) if fit.num_rows else np.zeros((1, dim))
    depth = max(0, min(DEEPEST, int(np.log2(max(1.0, n / LEAF))), int(np.log2(max(1.0, len(x) / 16))))) if depth is None else depth
    forest = Trees(x, top, trees, depth)
    share = measured_share(forest, x, k) if share is None else share

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(trees * 2**depth, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(forest.leaves(_matrix(b.column("v"))).ravel(), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["leaf", "n"])

    held = np.zeros(trees * 2**depth, np.int64)
    for r in index.select("v").mapInArrow(tally, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # a row for each leaf of a few trees
        held[r["leaf"]] = r["n"]
    first, several = cells_of(held, trees, block)
    schema = f"cell long, is_query boolean, key long, leaves array<int>, ids array<long>, v {kind}"

    def dealt(tree: int | None):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                leaf, node = forest.leaves(_matrix(b.column("v"))), b.column("node").to_numpy()
                for t in range(trees) if tree is None else (tree,):
                    own = leaf[:, t]
                    cell = first[own] + node % several[own]
                    leaves = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32)), pa.array(own.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(own), bool)), b.column("node"), leaves, b.column("ids"), b.column("v")], ["cell", "is_query", "key", "leaves", "ids", "v"])

        return place

    def probe(everything: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES):
                    b = batch.slice(at, QUERIES)
                    if everything:
                        i, leaf = (x.ravel() for x in np.broadcast_arrays(np.arange(b.num_rows)[:, None], np.flatnonzero(held[: 2**depth])[None, :]))
                    else:
                        order = forest.queue(_matrix(b.column("v")))
                        before = np.cumsum(held[order], axis=1) - held[order]
                        i, j = np.nonzero((before <= share * n) & (held[order] > 0))
                        leaf = order[i, j]
                    times = several[leaf]
                    i, leaf, nth = np.repeat(i, times), np.repeat(leaf, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    cell = first[leaf] + nth
                    order = np.lexsort((leaf, cell, i))
                    i, leaf, cell = i[order], leaf[order], cell[order]
                    starts = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (cell[1:] != cell[:-1]))) if len(i) else np.zeros(0, np.int64)
                    leaves = pa.ListArray.from_arrays(pa.array(np.append(starts, len(i)).astype(np.int32)), pa.array(leaf.astype(np.int32)))
                    own = pa.array(i[starts])
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(starts) + 1, np.int32)), pa.array([], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[starts]), pa.array(np.ones(len(starts), bool)), b.column("vec_id").take(own), leaves, none, b.column("v").take(own)], ["cell", "is_query", "key", "leaves", "ids", "v"])

        return work

    def meet(ask: DataFrame, everything: bool) -> DataFrame:
        met = index.select("node", "ids", "v").mapInArrow(dealt(0 if everything else None), schema).unionByName(ask.select("vec_id", "v").mapInArrow(probe(everything), schema))
        met = met.repartition("cell").sortWithinPartitions("cell", "is_query")
        lists = met.mapInArrow(_search(k), "query_id long, score array<double>, vec array<long>")
        return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")

    found = written(meet(asked, False), "nearest")

    # Queries that got fewer than k ids, and than there are, meet all vectors, in the leaves of one tree.
    some = [r["id"] for r in index.select(F.explode("ids").alias("id")).distinct().limit(k + 1).collect()]
    most: Column = F.lit(k) if len(some) > k else F.lit(len(some)) - F.col("vec_id").isin(some).cast("int")
    got = found.groupBy("query_id").agg(F.count("*").alias("got"))
    short = asked.join(got, asked.vec_id == got.query_id, "left").where(F.coalesce("got", F.lit(0)) < most)
    short = written(short.select("vec_id", "v"), "short")
    if short.isEmpty():
        return found
    whole = meet(short, True)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(found.columns).unionByName(whole)
