"""Nearest neighbours by largest inner product: vantage-point trees for each shard.

Inner products become distances by one more component: with M the largest norm of a shard, x gains
sqrt(M^2 - |x|^2) and a query gains 0, so the nearest is the one of the largest inner product. A tree
halves its points by the distance to a vantage point, and keeps the least and largest distance of
each half, which bound a query's distance to it from below (triangle inequality). A half is left out
if its bound times `factor` exceeds the query's k-th distance so far: a factor of 1 is exact, a
larger one leaves more out.

Rows are dealt to shards of about `shard` rows by a digest of their ids, queries to blocks of about
`block`, and each block meets each shard once, so neither side is ever in one place as a whole.
Equal vectors of a shard are one point with its smallest ids. Scores are sums of products in double
precision, from the first component to the last.

Ties, of equal vectors or of others, go to the smaller ids, however many there are. Bounds are compared
with room for rounding, so that a factor of 1 loses nothing. Null ids, and vectors that are null, zero,
or hold null or non-finite components take no part. Vectors of each length are searched among
themselves, in shards and blocks of their own. Repeated ids are candidates of their own (a query leaves
out all rows of its own id; a repeated query id is answered once, for its smallest vector). An empty
table on either side gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.window import Window

from weft.llm.common import key_runs

#: The production parameters: neighbours, rows of a shard, queries of a block, points of a leaf, pruning factor.
K = 20
SHARD = 8192
QUERIES = 4096
LEAF = 64
FACTOR = 1.05


class Tree:
    """Points in leaves, and for each inner node its vantage point and the ranges of its halves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int = K, leaf: int = LEAF):
        self.x, which = np.unique(x.astype(np.float64), axis=0, return_inverse=True)
        by = np.lexsort((ids, which.ravel()))
        ids, which = ids[by], which.ravel()[by]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (which[1:] != which[:-1])])
        copy = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        ids, which = ids[copy < k], which[copy < k]
        start = np.searchsorted(which, np.arange(len(self.x) + 1))
        #: The smallest ids of each point: k besides those of any one id.
        self.ids = [ids[a : min(b, a + 2 * k)] for a, b in zip(start, start[1:], strict=False)]
        norm = (self.x**2).sum(axis=1)
        self.reach = norm.max()
        self.points = np.column_stack([self.x, np.sqrt(np.maximum(self.reach - norm, 0))])
        self.leaves: list[np.ndarray] = []
        #: (vantage point, least and largest distance near, first leaf near, first leaf far, least and largest distance far, end)
        self.nodes: list[tuple[int, float, float, int, int, float, float, int]] = []
        self._split(np.arange(len(self.x)), leaf)

    def _split(self, own: np.ndarray, leaf: int) -> None:
        """Depth is the logarithm of a shard's size."""
        if len(own) <= leaf:
            self.leaves.append(own)
            return
        vantage = int(own[len(own) // 2])
        d = np.sqrt(((self.points[own] - self.points[vantage]) ** 2).sum(axis=1))
        rank = np.argsort(d, kind="stable")
        half = len(own) // 2
        first = len(self.leaves)
        self._split(own[rank[:half]], leaf)
        second = len(self.leaves)
        self._split(own[rank[half:]], leaf)
        d = d[rank]
        self.nodes.append((vantage, d[0], d[half - 1], first, second, d[half], d[-1], len(self.leaves)))

    def search(self, ids: np.ndarray, q: np.ndarray, k: int = K, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, neighbour's id, score), the k best of each query, ties to smaller ids; a query's own id is left out.

        Products of matrices find the candidates: all points within rounding of the k-th best so far, however
        many are tied. Their scores are then summed component by component, and those decide.
        """
        q = q.astype(np.float64)
        n, wide = len(q), k + 1  # a query's own point may be among the best
        norm = np.sqrt((q**2).sum(axis=1))
        square = self.reach + norm**2
        slack, margin = 1e-6 * np.sqrt(square), 1e-15 * (q.shape[1] + 8) * norm * np.sqrt(self.reach)
        apart = lambda products: np.sqrt(np.maximum(square[:, None] - 2 * products, 0))
        bound = np.zeros((n, len(self.leaves)))
        if self.nodes:
            d = apart(q @ self.x[[v[0] for v in self.nodes]].T)
            for c, (_, near_a, near_b, first, second, far_a, far_b, end) in enumerate(self.nodes):
                at = d[:, c, None]
                np.maximum(bound[:, first:second], np.maximum(at - near_b, near_a - at), out=bound[:, first:second])
                np.maximum(bound[:, second:end], np.maximum(at - far_b, far_a - at), out=bound[:, second:end])
        best = np.full((n, wide), -np.inf)  # inner products, the least first
        seen = np.zeros(bound.shape, bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(leaf: int, who: np.ndarray) -> None:
            if not len(who):
                return
            own = self.leaves[leaf]
            seen[who, leaf] = True
            score = q[who] @ self.x[own].T
            i, j = np.nonzero(score >= best[who, :1] - margin[who, None])
            found.append((who[i], own[j], score[i, j]))
            some = np.unique(i)
            both = np.concatenate([best[who[some]], score[some]], axis=1)
            best[who[some]] = np.partition(both, both.shape[1] - wide, axis=1)[:, -wide:]

        nearest = np.argsort(bound, axis=1, kind="stable")[:, :2]
        for r in range(nearest.shape[1]):  # a first radius, from the most promising leaves
            for leaf in np.unique(nearest[:, r]):
                visit(leaf, np.flatnonzero(nearest[:, r] == leaf))
        for leaf in np.argsort(bound.mean(axis=0), kind="stable"):
            radius = np.sqrt(np.maximum(square - 2 * best[:, 0], 0))
            visit(leaf, np.flatnonzero(~seen[:, leaf] & (bound[:, leaf] * factor <= radius + slack)))
        i, p, score = (np.concatenate(c) for c in zip(*found, strict=True))
        near = score >= best[i, 0] - margin[i]
        i, p = i[near], p[near]
        exact = np.zeros(len(i))
        for c in range(q.shape[1]):
            exact += self.x[p, c] * q[i, c]
        many = np.array([len(x) for x in self.ids])[p]
        i, exact, other = np.repeat(i, many), np.repeat(exact, many) + 0.0, np.concatenate([self.ids[x] for x in p])
        keep = other != ids[i]
        i, exact, other = i[keep], exact[keep], other[keep]
        order = np.lexsort((other, -exact, i))
        i, exact, other = i[order], exact[order], other[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return i[rank < k], other[rank < k], exact[rank < k]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(batch: pa.Table, column: str) -> bytes:
    """ids and vectors in one binary."""
    out = io.BytesIO()
    flat = batch[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    np.savez(out, ids=batch["id"].to_numpy(), x=flat.reshape(batch.num_rows, -1))
    return out.getvalue()


def _gathered(rows: DataFrame, key: str) -> DataFrame:
    """A binary for each key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, [key]):
            yield pa.RecordBatch.from_pydict({key: pa.array([group[key][0].as_py()], pa.int32()), "data": pa.array([_pack(group, "vector")], pa.binary())})

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} int, data binary")


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, shard: int = SHARD, block: int = QUERIES, leaf: int = LEAF, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows of vectors."""

    def ready(df: DataFrame) -> DataFrame:
        return df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("_d"))

    points = ready(vectors)
    asked = ready(queries).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("_d", F.size("vector"))
    n_asked = dict(tuple(x) for x in asked.groupBy("_d").count().collect())
    known, shards, blocks = [], 0, 0
    for d, n in sorted(tuple(x) for x in points.groupBy("_d").count().collect()):
        known.append((d, shards, max(1, -(-n // shard)), blocks, max(1, -(-n_asked.get(d, 0) // block))))
        shards, blocks = shards + known[-1][2], blocks + known[-1][4]
    places = F.broadcast(vectors.sparkSession.createDataFrame(known, "_d int, _shard int, _shards int, _block int, _blocks int"))
    dealt = points.join(places, "_d").select("id", "vector", (F.col("_shard") + F.pmod(F.xxhash64("id"), F.col("_shards"))).cast("int").alias("shard"))
    built = _gathered(dealt, "shard")
    questions = asked.join(places, "_d").select("id", "vector", (F.col("_block") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("_blocks"))).cast("int").alias("block"))
    own = F.broadcast(places.select("_shard", "_shards", F.explode(F.sequence("_block", F.col("_block") + F.col("_blocks") - 1)).alias("block")))
    each = _gathered(questions, "block").join(own, "block").select(F.col("data").alias("asked"), F.explode(F.sequence("_shard", F.col("_shard") + F.col("_shards") - 1)).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for b in batches:
            for s, data, asks in zip(b["shard"].to_pylist(), b["data"], b["asked"], strict=True):
                if s != last:
                    points = np.load(io.BytesIO(data.as_py()))
                    last, tree = s, Tree(points["ids"], points["x"], k, leaf)
                q = np.load(io.BytesIO(asks.as_py()))
                for at in range(0, len(q["ids"]), 512):
                    ids = q["ids"][at : at + 512]
                    i, other, score = tree.search(ids, q["x"][at : at + 512], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other), pa.array(score)], names=["query_id", "vec_id", "score"])

    met = built.join(each, "shard").select("shard", "data", "asked").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
