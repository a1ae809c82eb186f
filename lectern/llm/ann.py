"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample, every vector is put into one leaf of each tree, and a query walks
all trees through one priority queue, the smallest margin first, until it has seen a given share of the
index; the leaves' vectors are scored exactly and the best are merged by query.

How many trees, how deep and how large a share is measured: a few queries are searched in full, and the walk
that finds their neighbours with the fewest inner products is chosen. As one tree walked to its end is exact
search, none costs more than that: clustered vectors take several deep trees and a small share, vectors
without structure one shallow tree and most of it.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lectern.llm._common import materialize, named


@dataclass(frozen=True)
class ForestParams:
    trees: int = 8
    #: Vectors that the trees' split points are fitted on, at most.
    sample_rows: int = 20_000
    #: The trees are made as deep as leaves of so many vectors need, and so many of the sample allow.
    leaf_rows: int = 250
    sample_leaf_rows: int = 8
    #: Share of the neighbours of the measured queries that the walk must find, and how many queries that are.
    recall: float = 0.95
    measured_queries: int = 100
    #: Inner products that sending a query to one more leaf counts for.
    visit_rows: int = 200
    #: Rows that are scored together at most; a larger leaf is split.
    block_rows: int = 20_000
    seed: int = 7


@dataclass
class Forest:
    depth: int
    #: by tree and level a direction, by tree and inner node its split along the level's direction
    directions: np.ndarray
    splits: np.ndarray

    def cut(self, trees: int, depth: int) -> Forest:
        """The first trees down to a depth, whose leaves are those above the deeper ones."""
        return Forest(depth, self.directions[:trees, :depth], self.splits[:trees, : 2**depth - 1])

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered from 0."""
        out = np.zeros((len(v), len(self.directions)), np.int64)
        for t in range(len(self.directions)):
            along = v @ self.directions[t].T
            node = np.zeros(len(v), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (along[:, level] > self.splits[t][node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """By query, tree and leaf the sum of squared margins on the wrong side: what the queue orders by."""
        far = np.zeros((len(q), len(self.directions), 1))
        for level in range(self.depth):
            along = np.einsum("td,qd->qt", self.directions[:, level], q)
            margin = along[:, :, None] - self.splits[None, :, 2**level - 1 : 2 ** (level + 1) - 1]
            far = np.stack([far + np.where(margin > 0, margin**2, 0), far + np.where(margin > 0, 0, margin**2)], 3).reshape(len(q), len(self.directions), -1)
        return far

    def visits(self, q: np.ndarray, mass: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order in which one queue over all trees yields them, until they hold the share."""
        inner = 2**self.depth - 1
        along = self.directions @ q
        heap = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        out, seen = [], 0.0
        while heap and seen < share:
            far, t, node, level = heapq.heappop(heap)
            if node >= inner:
                if mass[t, node - inner]:
                    out.append((t, node - inner))
                    seen += mass[t, node - inner]
                continue
            margin = float(along[t, level] - self.splits[t, node])
            right = margin > 0
            heapq.heappush(heap, (far, t, 2 * node + 1 + right, level + 1))
            heapq.heappush(heap, (far + margin * margin, t, 2 * node + 2 - right, level + 1))
        return out


def fit_forest(sample: np.ndarray, rows: int, p: ForestParams) -> Forest:
    """A random direction for each level of each tree, split at the medians of the sample's rows in a node."""
    if not len(sample):
        return Forest(0, np.zeros((p.trees, 0, 0)), np.zeros((p.trees, 0)))
    want = math.ceil(math.log2(max(1, rows / p.leaf_rows)))
    depth = max(0, min(want, int(math.log2(max(1, len(sample) / p.sample_leaf_rows)))))
    rng = np.random.default_rng(p.seed)
    directions = rng.normal(size=(p.trees, depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits = np.zeros((p.trees, 2**depth - 1))
    for t in range(p.trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            along = sample @ directions[t, level]
            order = np.lexsort((along, node))
            here = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            start, stop = np.searchsorted(node[order], here), np.searchsorted(node[order], here, "right")
            middle = np.clip((start + stop - 1) // 2, 0, len(sample) - 1)
            splits[t, here] = np.where(stop > start, along[order][middle], 0.0)
            node = 2 * node + 1 + (along > splits[t][node])
    return Forest(depth, directions, splits)


@dataclass
class Walk:
    """A forest, the rows of each leaf, the share to see, and what that is expected to take for a query: inner
    products as a share of the rows, leaves, and the neighbours found of the measured queries."""

    forest: Forest
    sizes: np.ndarray
    share: float
    products: float
    leaves: float
    found: float


def choose(forest: Forest, sizes: np.ndarray, q: np.ndarray, near: list[np.ndarray], p: ForestParams) -> Walk:
    """The cheapest walk that finds enough of the neighbours. ``near`` has for each measured query the leaves
    of its neighbours, by neighbour and tree."""
    n = max(1, int(sizes[0].sum()))
    best_cost, best_walk = math.inf, None
    trees = 1
    options = []
    while trees <= len(sizes):
        options += [(trees, d) for d in range(forest.depth, -1, -1) if trees == 1 or d]
        trees *= 2
    for trees, depth in options:
        own = forest.cut(trees, depth)
        size = sizes[:trees].reshape(trees, 2**depth, -1).sum(2)
        far = own.distances(q).reshape(len(q), -1)
        far[:, size.reshape(-1) == 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        mass = (size.reshape(-1) / n)[order]
        before = np.cumsum(mass, 1) - mass
        at = np.empty_like(order)
        np.put_along_axis(at, order, np.arange(order.shape[1])[None, :], 1)
        need = []
        for i, leaves in enumerate(near):
            if len(leaves):
                place = np.arange(trees) * 2**depth + (leaves[:, :trees] >> (forest.depth - depth))
                need.append(before[i][at[i][place]].min(1))
        need = np.sort(np.concatenate(need)) if need else np.zeros(1)
        share = float(need[min(len(need) - 1, math.ceil(p.recall * len(need)) - 1)]) + 1e-9
        seen = (before < share) & (mass > 0)
        products, visits = float((mass * seen).sum(1).mean()) if len(q) else 1.0, float(seen.sum(1).mean()) if len(q) else 1.0
        cost = products * n + visits * p.visit_rows
        if cost < best_cost:
            best_cost, best_walk = cost, Walk(own, size, share, products, visits, float((need < share).mean()))
    return best_walk


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) without null or zero vectors and those that hold null or non-finite components; of
    repeated ids the least vector. Vectors of floats stay so, others become doubles."""
    own = vectors.schema[vector_col].dataType
    single = isinstance(own, ArrayType) and isinstance(own.elementType, FloatType)
    v = named(vector_col) if single else named(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.select(named(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", bad))
    return good.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """The vectors as they are stored; products are of doubles."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec_id").to_numpy()


_CELL = "cell long, kind int, id long, v binary"
_CELL_ARROW = pa.schema([("cell", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("v", pa.binary())])
_ROW, _QUERY = 0, 1


def _spread(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts


def _cells(walk: Walk, blocks: np.ndarray, every: int):
    """Index rows by leaf and block, once a tree, and queries by all blocks of the leaves they visit."""
    first = (np.cumsum(blocks.reshape(-1)) - blocks.reshape(-1)).reshape(blocks.shape)
    mass = walk.sizes / max(1, walk.sizes[0].sum())

    def rows(cell, kind, ids, blobs):
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), kind, np.int32)), pa.array(ids), pa.array(blobs, pa.binary())], schema=_CELL_ARROW)

    def run(batches):
        trees = np.arange(len(blocks))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = _ids(batch), _matrix(batch)
            exact = v.astype(np.float64)
            leaf = walk.forest.leaves(exact)
            cell = first[trees, leaf] + _spread(ids, 1 << 30)[:, None] % blocks[trees, leaf]
            blobs = [x.tobytes() for x in np.ascontiguousarray(v)]
            yield rows(cell.reshape(-1), _ROW, np.repeat(ids, len(trees)), [b for b in blobs for _ in trees])
            to, who = [], []
            for i in np.flatnonzero(ids % every == 0):
                own = [int(first[t, x]) + b for t, x in walk.forest.visits(exact[i], mass, walk.share) for b in range(int(blocks[t, x]))]
                to += own
                who += [i] * len(own)
                if len(to) > 1 << 16:
                    yield rows(np.array(to, np.int64), _QUERY, ids[who], [blobs[k] for k in who])
                    to, who = [], []
            if to:
                yield rows(np.array(to, np.int64), _QUERY, ids[who], [blobs[k] for k in who])

    return run


def best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, itself apart, ties to the smaller id. Scores are summed the same
    way for every pair, so equal vectors tie exactly."""
    out_q, out_id, out_s = [], [], []
    rows = max(1, min(512, (1 << 22) // max(1, len(ids))))
    for a in range(0, len(qid), rows):
        rough = q[a : a + rows] @ v.T
        rough[qid[a : a + rows, None] == ids[None, :]] = -np.inf
        m = min(k, len(ids))
        least = -np.partition(-rough, m - 1, axis=1)[:, m - 1]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
        for b in range(0, len(i), 1 << 16):
            ib, jb = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            out_q.append(ib + a)
            out_id.append(ids[jb])
            out_s.append((q[a + ib] * v[jb]).sum(1))
    if not out_q:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    return top(np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s), k)


def top(qi: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -s, qi))
    qi, ids, s = qi[order], ids[order], s[order]
    start = np.flatnonzero(np.append(True, qi[1:] != qi[:-1])) if len(qi) else np.zeros(0, np.int64)
    rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.append(start, len(qi))))
    keep = rank < k
    return qi[keep], ids[keep], s[keep]


_FOUND = "query_id long, vec_id long, score double"


def _score(k: int, dtype, queries: int = 1024):
    """The best of each cell for each query that visits it. A cell's rows come first and are held, which their
    number bounds; its queries follow and are held a few at a time."""
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    matrix = lambda blobs: np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)

    def run(batches):
        cell, ids, blobs, v, qid, q = None, [], [], None, [], []

        def close():
            nonlocal qid, q, v
            if not qid or not ids:
                qid, q = [], []
                return
            if v is None:
                v = matrix(blobs)
            own = np.array(qid)
            at, found, score = best(own, matrix(q), np.array(ids), v, k)
            qid, q = [], []
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(found), pa.array(score)], schema=out)

        for batch in batches:
            for c, kind, i, x in zip(*(batch.column(n).to_pylist() for n in ("cell", "kind", "id", "v"))):
                if c != cell:
                    yield from close()
                    cell, ids, blobs, v = c, [], [], None
                if kind == _ROW:
                    ids.append(i)
                    blobs.append(x)
                else:
                    qid.append(i)
                    q.append(x)
                    if len(qid) == queries:
                        yield from close()
        yield from close()

    return run


def _measured(q_ids: np.ndarray, q: np.ndarray, forest: Forest, k: int):
    """The best of each task's rows for each measured query, with their leaves."""
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaves", pa.binary())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            ids, v = _ids(batch), _matrix(batch).astype(np.float64)
            at, found, score = best(q_ids, q, ids, v, k)
            order = np.argsort(ids)
            row = order[np.searchsorted(ids[order], found)]
            leaf = forest.leaves(v[row])
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(found), pa.array(score), pa.array([x.tobytes() for x in leaf], pa.binary())], schema=out)

    return run


def _best_of(found: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score", *more).where(F.col("rank") <= k)


def fit(rows: DataFrame, k: int, every: int, p: ForestParams) -> Walk:
    """The walk for the rows (vec_id, v) of ``usable``. The driver holds the sample, the measured queries with
    their neighbours and a number for each leaf, all of which the parameters bound."""
    n = rows.count()
    drawn = lambda df, m: df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).toArrow()
    full = lambda t: np.array(t.column("v").to_pylist(), np.float64).reshape(t.num_rows, -1 if t.num_rows else 0)
    forest = fit_forest(full(drawn(rows, p.sample_rows)), n, p)
    shape = (p.trees, 2**forest.depth)

    def count(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                leaf = forest.leaves(_matrix(batch).astype(np.float64))
                for t in range(p.trees):
                    total[t] += np.bincount(leaf[:, t], minlength=shape[1])
        at = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_pydict({"leaf": pa.array(at), "n": pa.array(total.reshape(-1)[at])})

    sizes = np.zeros(shape[0] * shape[1], np.int64)
    counted = rows.mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    sizes[counted.column("leaf").to_numpy()] = counted.column("n").to_numpy()
    sizes = sizes.reshape(shape)
    if not forest.depth:
        return Walk(forest.cut(1, 0), sizes[:1], 1.0, 1.0, 1.0, 1.0)
    queries = drawn(rows.where(F.col("vec_id") % every == 0), p.measured_queries)
    q_ids, q = queries.column("vec_id").to_numpy().astype(np.int64), full(queries)
    found = rows.mapInArrow(_measured(q_ids, q, forest, k), _FOUND + ", leaves binary")
    near: dict[int, list[bytes]] = {int(i): [] for i in q_ids}
    for r in _best_of(found, k, "leaves").collect():
        near[r["query_id"]].append(r["leaves"])
    return choose(forest, sizes, q, [np.frombuffer(b"".join(x), np.int64).reshape(len(x), -1) for x in near.values()], p)


def search(vectors: DataFrame, k: int = 20, every: int = 20, p: ForestParams = ForestParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest that the forest finds of each row whose id is
    divisible by ``every``, by inner product, nearest first and ties to the smaller id.

    Rows with a null id and vectors that ``usable`` leaves out take no part; vectors must have one length.
    Of repeated ids the least vector counts. With fewer candidates than k all that are in visited leaves are
    returned; a table that fits one leaf is searched in full. No rows give none; other columns aren't read.
    """
    rows = materialize(usable(vectors, id_col, vector_col), "ann-vectors")
    dtype = np.float32 if isinstance(rows.schema["v"].dataType.elementType, FloatType) else np.float64
    walk = fit(rows, k, every, p)
    blocks = np.maximum(1, -(-walk.sizes // p.block_rows))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = rows.mapInArrow(_cells(walk, blocks, every), _CELL)
    found = cells.repartition(parts, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_score(k, dtype), _FOUND)
    if len(walk.sizes) > 1:  # a vector may be met in several trees
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _best_of(found, k)
