"""Approximate nearest neighbours: a vantage-point tree per shard.

A node keeps a vantage point and the median distance mu of its points from
it.  With tau a query's tenth-best distance so far, the inner side can hold
nothing nearer than d - mu and the outer side nothing nearer than mu - d; a
side is skipped when that bound times ``factor`` exceeds tau.  Factor 1 is
exact; larger ones skip more.

Shards are dealt by row.  A shard's vectors move once, its tree is built once,
and all queries stream past it in blocks, so a task holds one shard and one
block; the best of all shards follow from a ranking per query.

Defined cases: vectors that are null, zero, of another length than most (no
distance to the others is defined), or hold null or non-finite components
take no part; ties go to the smaller vec_id; rows without vec_id take no part;
repeated rows are candidates each, except those with the query's own vec_id,
and ask once, the smallest vector; an empty table gives none; extra columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_parts, mark, release, stored, tidy

#: Bytes of a shard's vectors, vectors from which on more shards are worth a task, queries of a block, points of a leaf.
SHARD_BYTES, SHARD, QUERIES, LEAF = 64_000_000, 5_000, 2_000, 32
OUT = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    d = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    return d.where(_takes_part(F.col("vec_id"), F.col("v")))


def _takes_part(vec_id: Column, v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vec_id.isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def distances(columns: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances (point, row): rows given by component, squares added in the components' order."""
    total = np.zeros((len(points), columns.shape[1]))
    for c, p in zip(columns, points.T, strict=True):
        d = p[:, None] - c[None, :]
        d *= d
        total += d
    return np.sqrt(total)


class Tree:
    """Vantage-point tree over the rows of ``x``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        o = np.argsort(ids, kind="stable")
        self.ids, self.x, self.leaf = ids[o], np.ascontiguousarray(x[o].T), leaf
        self.squares = (self.x * self.x).sum(axis=0)
        self.computed = 0  # distances of searches
        self.leaves: list[np.ndarray] = []
        self.root = self._node(np.arange(len(ids)))

    def _leaf(self, rows: np.ndarray) -> int:
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def _node(self, rows: np.ndarray):
        """A leaf's number, or (vantage row, radius, distance of the outer shell, inner side, outer side)."""
        if len(rows) <= self.leaf:
            return self._leaf(rows)
        vantage = rows[np.random.default_rng(len(rows)).integers(len(rows))]
        d = distances(self.x[:, rows], self.x[:, [vantage]].T)[0]
        mu = np.median(d)
        inner = d <= mu
        if inner.all():  # half of the points or more are alike: the rest, if any, goes outside
            inner = d < mu
            if not inner.any():
                return self._leaf(rows)
            mu = d[inner].max()
        return vantage, float(mu), float(d[~inner].min()), self._node(rows[inner]), self._node(rows[~inner])

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and vec_ids of each query's ``k`` nearest, its own vec_id left out; missing ones have distance inf.

        Each query first descends to the leaf it lies in, which gives it a first tau; then
        every node is met once, with all queries that its bounds don't keep out.
        """
        best_d = np.full((len(q), k), np.inf)
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        home = np.full(len(q), -1)
        slack = 1 + 1e-12
        columns, squares = np.ascontiguousarray(q.T), (q * q).sum(axis=1)
        doubt = 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps

        def measured(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
            """Distances (query, row); inf where the expanded square, within its rounding error, is beyond the query's tau."""
            both = squares[w][:, None] + self.squares[rows][None, :]
            about = both - 2 * (q[w] @ self.x[:, rows])
            a, b = np.nonzero(~(about - doubt * both - 1e-300 > best_d[w, -1:] ** 2 * slack))
            total = np.zeros(len(a))
            qa, xb = w[a], rows[b]
            for p, c in zip(columns, self.x, strict=True):
                d = p[qa] - c[xb]
                d *= d
                total += d
            about.fill(np.inf)
            about[a, b] = np.sqrt(total)
            return about

        def offer(rows: np.ndarray, who: np.ndarray) -> None:
            block = max(1, 2_000_000 // len(rows))
            for a in range(0, len(who), block):
                w = who[a : a + block]
                d = measured(rows, w)
                self.computed += d.size
                d[self.ids[rows] == query_ids[w][:, None]] = np.inf
                better = np.flatnonzero((d <= best_d[w, -1:]).any(axis=1) & np.isfinite(d).any(axis=1))
                if not len(better):
                    continue
                w, d = w[better], d[better]
                near = np.argsort(d, axis=1, kind="stable")[:, :k]  # a leaf's vec_ids ascend, so ties are in order
                near_d = np.take_along_axis(d, near, 1)
                all_d = np.concatenate([best_d[w], near_d], 1)
                all_i = np.concatenate([best_i[w], np.where(np.isfinite(near_d), self.ids[rows][near], np.iinfo(np.int64).max)], 1)
                o = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best_d[w], best_i[w] = np.take_along_axis(all_d, o, 1), np.take_along_axis(all_i, o, 1)

        def scan(leaf: int, who: np.ndarray) -> None:
            rows = self.leaves[leaf]
            for a in range(0, len(rows) if len(who) else 0, 20_000):
                offer(rows[a : a + 20_000], who)

        def split(node, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distances to the vantage point, and which queries are nearer to the inner shell."""
            vantage, mu, far = node[:3]
            d = distances(self.x[:, [vantage]], q[who])[:, 0]
            self.computed += d.size
            return d, d - mu <= far - d

        def descend(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, int):
                home[who] = node
                scan(node, who)
                return
            _, near = split(node, who)
            descend(node[3], who[near])
            descend(node[4], who[~near])

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, int):
                scan(node, who[home[who] != node])
                return
            _, mu, far, inside, outside = node
            d, near = split(node, who)
            go_in = lambda: visit(inside, who[(d - mu) * factor <= best_d[who, -1] * slack])
            go_out = lambda: visit(outside, who[(far - d) * factor <= best_d[who, -1] * slack])
            for go in (go_in, go_out) if 2 * near.sum() >= len(who) else (go_out, go_in):
                go()

        with np.errstate(over="ignore", invalid="ignore"):
            descend(self.root, np.arange(len(q)))
            visit(self.root, np.arange(len(q)))
        return best_d, best_i


def _searcher(k: int, factor: float):
    """Rows (shard, kind, vec_id, v) sorted by shard and kind: first a shard's vectors, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        points: list[pa.RecordBatch] = []
        mat = lambda b: np.asarray(b.column(3).flatten(), np.float64).reshape(b.num_rows, -1)
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if a == b:
                    continue
                part, (shard, kind) = batch.slice(a, b - a), divmod(int(key[a]), 2)
                if shard != now:
                    now, tree, points = shard, None, []
                if not kind:
                    points.append(part)
                    continue
                if tree is None and points:
                    tree = Tree(np.concatenate([p.column(2).to_numpy() for p in points]), np.concatenate([mat(p) for p in points]))
                    points = []
                for at in range(0, part.num_rows if tree else 0, QUERIES):
                    some = part.slice(at, QUERIES)
                    ids = some.column(2).to_numpy()
                    d, i = tree.search(ids, mat(some), k, factor)
                    ok = np.isfinite(d)
                    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], d.shape)[ok]), pa.array(i[ok]), pa.array(d[ok])], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 10, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` that the condition ``queries`` selects."""
    spark, since = vectors.sparkSession, mark()
    v = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()))
    n, width = v.agg(F.count(F.lit(1)), F.mode(F.size("v"), True)).first()
    v = v.where(F.size("v") == (width or 0))
    shards = max(1, -(-n * (width or 0) * 8 // SHARD_BYTES), min(hash_parts(spark), -(-n // SHARD)))
    points = v.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    ask = v.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    ask = ask.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = points.unionByName(ask).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = stored(dealt.mapInArrow(tidy(_searcher(k, factor)), OUT))
    release(spark, since, found)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns: every hundredth vec_id asks."""
    return nearest(vectors, F.col("vec_id") % 100 == 0)
