"""Exact top-k search by inner product over KD-trees, one for each shard.

Vectors are dealt to shards; a shard's tree splits at the median of the widest dimension, and every node keeps the tight
box of its vectors. A box bounds the score of all it holds: each dimension takes the end that suits the query's sign. A
query goes through a tree best first, from the node with the highest bound on, and stops when no bound reaches its
k-th score. Queries first search one shard each; the k-th score found there goes with them to the other shards, where
most of a tree is then out of reach. The best of each shard are merged by query.

A task holds one shard's vectors and a batch of queries. Queries are sent to every shard, as each has to be asked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import ints
from ..spark import cut
from ._spark import read

TOP = 5
SCALE = 256
SHARD_ROWS = 8192
LEAF = 64
EXACT = 2.0**53  # integers below it are exact as doubles
LOWEST, HIGHEST = -(2**63), 2**63 - 1


class Tree:
    """KD-tree over rows of integers (as doubles)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray) -> None:
        order = np.arange(len(rows))
        self.low, self.high, self.child, self.span = [], [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            a, z, parent = todo.pop()
            own = rows[order[a:z]]
            low, high = own.min(0), own.max(0)
            me = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.child.append([])
            self.span.append((a, z))
            if parent >= 0:
                self.child[parent].append(me)
            with np.errstate(over="ignore"):
                wide = int(np.argmax(high - low))
            if z - a > LEAF and high[wide] > low[wide]:
                mid = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(own[:, wide], mid)]
                todo += [(a, a + mid, me), (a + mid, z, me)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.rows, self.ids = rows[order], ids[order]
        self.most = float(np.abs(rows).max()) if rows.size else 0.0

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query its k best (score, -id), of those that reach floor."""
        dim = self.rows.shape[1]
        peak = float(np.abs(queries).max()) if queries.size else 0.0
        safe = self.most * peak * dim < EXACT
        if safe:
            bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for i, q in enumerate(queries):
            best: list[tuple[int, int]] = []
            least = int(floor[i])
            exact_q = None if safe else [int(x) for x in q]
            bound = bounds[i] if safe else [sum(x * int(h if x > 0 else w) for x, h, w in zip(exact_q, hi, lo, strict=True)) for hi, lo in zip(self.high, self.low, strict=True)]
            heap = [(-bound[0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                if min(max(-b, LOWEST), HIGHEST) < least:
                    break
                if self.child[node]:
                    for c in self.child[node]:
                        heapq.heappush(heap, (-bound[c], c))
                    continue
                a, z = self.span[node]
                if safe:
                    scores = (self.rows[a:z] @ q).astype(np.int64)
                    pick = np.flatnonzero((scores >= least) & (self.ids[a:z] != own[i]))
                    found = zip(scores[pick].tolist(), (-self.ids[a:z][pick]).tolist(), strict=True)
                else:
                    found = [(min(max(sum(x * int(y) for x, y in zip(exact_q, r, strict=True)), LOWEST), HIGHEST), -int(v)) for r, v in zip(self.rows[a:z], self.ids[a:z], strict=True) if v != own[i]]
                for x in found:
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x > best[0]:
                        heapq.heapreplace(best, x)
                if len(best) == k:
                    least = max(least, best[0][0])
            yield best


def _scaled(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b["embedding"]
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.floor(x * scale)
            bad = np.r_[0, np.cumsum(~np.isfinite(v))]
            end = np.cumsum(size)
            ok = (bad[end] == bad[end - size]) & np.asarray(column.is_valid()) & np.asarray(b["vec_id"].is_valid())
            rows = np.flatnonzero(ok)
            raw = [v[end[r] - size[r] : end[r]].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(rows)), pa.array(raw, pa.binary())], names=["vec_id", "vector"])

    return run


def _search(k: int):
    """Rows come sorted by cell (a shard and a length of vectors), vectors ahead of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ids, tree = None, [], [], None
        for b in batches:
            cells, kinds = ints(b["cell"]), ints(b["kind"])
            edges = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])]) if len(cells) else []
            for s, e in zip(edges, [*edges[1:], len(cells)], strict=True):
                if cells[s] != cell:
                    cell, held, ids, tree = cells[s], [], [], None
                part = b.slice(s, e - s)
                rows = np.frombuffer(b"".join(part["vector"].to_pylist()), np.float64).reshape(e - s, -1)
                if kinds[s] == 0:
                    held.append(rows)
                    ids.append(ints(part["vec_id"]))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(held), np.concatenate(ids))
                for at in range(0, e - s, 512):
                    own = ints(part["vec_id"])[at : at + 512]
                    out = [[], [], []]
                    for q, best in zip(own.tolist(), tree.search(rows[at : at + 512], own, ints(part["floor"])[at : at + 512], k), strict=True):
                        for score, minus in best:
                            out[0].append(q)
                            out[1].append(-minus)
                            out[2].append(score)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best vectors for every query, ties to the smaller id.

    Components x become floor(scale * x); scores are integer inner products, those beyond a long are given as the nearest
    long. A vector that is null or holds null or non-finite components takes no part, nor does a row without an id; what
    overflows when it is scaled counts as non-finite. A query meets vectors of its own length only, and none of its own id.
    Rows that repeat an id are each a candidate; of the queries that repeat one, the least vector by its bytes counts.
    Empty vectors score 0. Empty tables give an empty result.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).mapInArrow(_scaled(scale), "vec_id long, vector binary")
    rows = clean(vectors).where("length(vector) > 0")
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    # a shard with a length of vectors is a cell
    cell = lambda shard: F.xxhash64(shard, F.length("vector"))
    asked = cut(clean(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("home", home))
    base = rows.select(cell(home).alias("cell"), F.lit(0).alias("kind"), "vec_id", "vector", F.lit(LOWEST).alias("floor"))

    def ask(q: DataFrame) -> DataFrame:
        sent = q.where("length(vector) > 0").select(cell(F.col("shard")).alias("cell"), F.lit(1).alias("kind"), "vec_id", "vector", "floor")
        return base.unionByName(sent).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_search(k), "query_id long, vec_id long, score long")

    first = cut(ask(asked.select("vec_id", "vector", F.col("home").alias("shard"), F.lit(LOWEST).alias("floor"))))
    kth = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("have")).select(F.col("query_id").alias("vec_id"), F.when(F.col("have") >= k, F.col("low")).otherwise(F.lit(LOWEST)).alias("floor"))
    others = asked.join(kth, "vec_id", "left").select("vec_id", "vector", "home", F.coalesce("floor", F.lit(LOWEST)).alias("floor"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")).where("shard != home")
    every = first if shards == 1 else first.unionByName(ask(others))
    blank = asked.where("length(vector) = 0").select(F.col("vec_id").alias("query_id"))
    empty = clean(vectors).where("length(vector) = 0").select("vec_id").orderBy("vec_id").limit(k + 1)
    every = every.unionByName(blank.join(F.broadcast(empty), F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.lit(0).cast("long").alias("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five of all rows for each row whose id is divisible by 50; see ``top_k``."""
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
