"""Exact top-k by inner product through KD-trees, one for each shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash of their row. A shard builds a KD-tree once:
median splits of the widest dimension, a tight bounding box at every node. The best a box can offer a
query is the sum over dimensions of the larger of q*low and q*high; nodes are visited best first until
that bound falls below the k-th score so far. Equal bounds are followed, since a smaller id wins a tie.

Each query first visits the tree of its own shard, which gives it a k-th score. Then all queries, in blocks
of about ``block_rows``, meet all other trees in one job over a grid: a cell holds a few trees (at most
``cell_trees``) and streams a stripe of the blocks (at most ``stripe_blocks``) past them. The k-th scores of the
home trees travel with the blocks, and within a cell on from tree to tree, where whole trees and branches below
them are skipped. Nothing passes through the driver and nothing is broadcast: a block is shuffled once to each
group of trees, a tree once to each stripe of blocks, and a cell that is lost is the work of one task. The
work is queries x rows at worst, which the contract fixes.

Null vectors and those with null, NaN or infinite components take no part. Every row is a candidate of its
own, also where rows share an id, and each row with a query's id asks, except for rows of that id; the best
of all of them are the id's result. Vectors of different length never meet. Scores must fit a long. Ties go to the smaller id.
Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

LEAF = 256
#: Queries whose bounds a task works out together.
SLICE = 2048
#: Stands for the k-th score of a query that has fewer than k. Whole numbers throughout: doubles round beyond 2^53.
NO_SCORE = np.iinfo(np.int64).min
#: A query's row and id, and what it found.
FOUND = ["row", "query_id", "vec_id", "score"]
SCHEMA = ", ".join(f"{c} long" for c in FOUND)


class KDTree:
    """Points in the order of the leaves; ``nodes`` has each node's first and last point and its children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.lows: list | np.ndarray = []
        self.highs: list | np.ndarray = []
        self.nodes: list[tuple[int, int, int, int]] = []
        order = np.arange(len(ids))
        self._grow(points, order, 0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.lows, self.highs = np.array(self.lows), np.array(self.highs)
        self.largest = int(np.abs(points).max(initial=1))

    def _grow(self, points: np.ndarray, order: np.ndarray, begin: int, end: int) -> int:
        me, part = len(self.nodes), points[order[begin:end]]
        low, high = part.min(0), part.max(0)
        self.lows.append(low)
        self.highs.append(high)
        self.nodes.append((begin, end, 0, 0))
        if end - begin > LEAF:
            order[begin:end] = order[begin:end][np.argsort(part[:, np.argmax(high - low)], kind="stable")]
            half = (begin + end) // 2
            self.nodes[me] = (begin, end, self._grow(points, order, begin, half), self._grow(points, order, half, end))
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most any point of each node's box can score with each query."""
        return np.maximum(queries, 0) @ self.highs.T + np.minimum(queries, 0) @ self.lows.T

    def search(self, query_id: int, q: np.ndarray, bound: np.ndarray, k: int, kth: int, best: list[tuple[int, int]]) -> None:
        """Put what scores no worse than ``kth`` into ``best``, a heap of at most ``k`` (score, -id)."""
        open_nodes = [(-bound[0], 0)]
        while open_nodes:
            b, node = heapq.heappop(open_nodes)
            limit = max(kth, best[0][0]) if len(best) == k else kth
            if -b < limit:
                break
            begin, end, *children = self.nodes[node]
            if children[1]:
                for c in children:
                    heapq.heappush(open_nodes, (-bound[c], c))
                continue
            score, ids = self.points[begin:end] @ q, self.ids[begin:end]
            good = np.flatnonzero((score >= limit) & (ids != query_id))
            if len(good) > k:
                good = good[np.lexsort((ids[good], -score[good]))[:k]]
            for s, i in zip(score[good].tolist(), ids[good].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                else:
                    heapq.heappushpop(best, (s, -i))


@dataclass
class Queries:
    """Queries of one length: their rows, ids, vectors, home shards, and the k-th scores known of them."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    homes: np.ndarray
    kth: np.ndarray


def finite(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False)) & (F.size(vector) > 0)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Integer vectors ``v`` by ``vec_id``; rows that take no part are gone."""
    rows = df.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull())
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.size(vector_col).alias("dim"))


def build(vectors: DataFrame) -> DataFrame:
    """A KD-tree (``tree``) for each ``dim`` and ``shard``."""

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        points = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        tree = KDTree(t["vec_id"].to_numpy(), points)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return vectors.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, tree binary")


def in_blocks(asked: DataFrame) -> DataFrame:
    """The queries of each ``block`` and ``dim``, packed."""

    def run(t: pa.Table) -> pa.Table:
        packed = pickle.dumps(queries_of(t))
        return pa.table({"block": t["block"][:1], "dim": t["dim"][:1], "queries": pa.array([packed], pa.binary())})

    return asked.groupBy("block", "dim").applyInArrow(run, "block int, dim int, queries binary")


def queries_of(t: pa.Table) -> Queries:
    """Rows of one length as queries."""
    vectors = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, t["dim"][0].as_py())
    kth = t["kth"].fill_null(NO_SCORE).to_numpy() if "kth" in t.column_names else np.full(len(t), NO_SCORE)
    return Queries(t["row"].to_numpy(), t["vec_id"].to_numpy(), vectors, t["shard"].to_numpy(), kth)


def visit(trees: list[tuple[int, KDTree]], q: Queries, k: int, home: bool) -> pa.Table:
    """Each query's best of its home tree, or of all trees but that one."""
    best: dict[int, list[tuple[int, int]]] = {}
    for shard, tree in trees:
        mine = np.flatnonzero((q.homes == shard) == home)
        exact = float(tree.largest) * float(np.abs(q.vectors).max(initial=1)) * q.vectors.shape[1] < 2**52
        kind = np.float64 if exact else np.int64  # doubles are exact there, and fast
        if tree.points.dtype != kind:
            tree.points, tree.lows, tree.highs = (x.astype(kind) for x in (tree.points, tree.lows, tree.highs))
        for at in range(0, len(mine), SLICE):
            part = mine[at : at + SLICE]
            vectors = q.vectors[part].astype(kind)
            for i, v, bound in zip(part.tolist(), vectors, tree.bounds(vectors), strict=True):
                tree.search(int(q.ids[i]), v, bound, k, int(q.kth[i]), best.setdefault(i, []))
    rows = [(int(q.rows[i]), int(q.ids[i]), -v, int(s)) for i, heap in best.items() for s, v in heap]
    columns = zip(*rows, strict=True) if rows else [()] * len(FOUND)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=FOUND)


def from_home(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best that each query finds in the tree of its own shard."""

    def run(tree: pa.Table, t: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table([pa.array([], pa.int64())] * len(FOUND), names=FOUND)
        return visit([(tree["shard"][0].as_py(), pickle.loads(tree["tree"][0].as_py()))], queries_of(t), k, True)

    return trees.groupBy("dim", "shard").cogroup(asked.groupBy("dim", "shard")).applyInArrow(run, SCHEMA)


def from_others(trees: DataFrame, blocks: DataFrame, k: int, groups: int, stripes: int) -> DataFrame:
    """The best that each query finds in all other trees: one task for each group of trees and stripe of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["cell"] != cell:
                    cell, held = r["cell"], {}
                if r["shard"] is not None:  # a cell's trees come before its blocks
                    held.setdefault(r["dim"], []).append((r["shard"], pickle.loads(r["packed"])))
                elif r["dim"] in held:
                    yield from visit(held[r["dim"]], pickle.loads(r["packed"]), k, False).to_batches()

    small_batches(trees.sparkSession)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = trees.select("dim", "shard", F.col("tree").alias("packed"), F.pmod("shard", F.lit(groups)).alias("group"), every(stripes).alias("stripe"))
    right = blocks.select("dim", F.lit(None).cast("int").alias("shard"), F.col("queries").alias("packed"), every(groups).alias("group"), F.pmod("block", F.lit(stripes)).alias("stripe"))
    cells = left.unionByName(right).select("dim", "shard", "packed", (F.col("group") * stripes + F.col("stripe")).cast("int").alias("cell"))
    dealt = cells.repartitionById(groups * stripes, F.col("cell")).sortWithinPartitions("cell", F.col("shard").isNull())
    return dealt.mapInArrow(run, SCHEMA)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, shard_rows: int = 8192, block_rows: int = 2048, cell_trees: int = 16, stripe_blocks: int = 256) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows whose id is divisible by ``every``."""
    vectors = materialise(quantised(df, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    vectors = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    trees = materialise(build(vectors), "trees")
    asked = vectors.where(F.col("vec_id") % every == 0)
    home = materialise(from_home(trees, asked, k), "home-trees")
    known = home.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("row", "kth")

    # A small gallery has fewer trees a cell, so that all cores take part; the rows found are the same.
    blocks = max(1, math.ceil(asked.count() / block_rows))
    groups = max(math.ceil(shards / cell_trees), min(shards, df.sparkSession.sparkContext.defaultParallelism))
    packed = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int")).join(known, "row", "left")
    others = from_others(trees, in_blocks(packed), k, groups, math.ceil(blocks / stripe_blocks))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = home.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
