"""Nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of hash bits (signs of random projections of the centred vectors) and keeps
the strings sorted. A query descends each tree to its longest matching prefix, then all trees ascend together, one bit at a time,
until the ranges under the prefixes hold enough vectors; these are ranked by exact distance.

The forest is sharded: a shard holds the sorted arrays of at most about `shard_rows` vectors and answers blocks of queries; the best
of all shards are merged. So every row is indexed, and no task holds more than a shard and a block. A shard's forest is
made for each block of up to `query_rows` queries, which costs about a quarter of what a full block does.

How many rows must be ranked depends on the data: of vectors without any structure, whose tenth neighbour lies at an angle of 66 degrees
in 64 dimensions, two neighbours share a hash bit with probability 0.63 and two others with 0.5, so no number of
trees reaches a recall of 0.9 without looking at a large part of the rows. `share` sets how far the trees ascend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Forest:
    """Sorted hash strings of `trees` trees over the rows of `x`."""

    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int) -> None:
        self.x, self.bits = x, bits
        self.center = x.mean(axis=0)
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(trees, x.shape[1], bits)).astype(np.float32)
        self.weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
        codes = self.codes(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) strings of `bits` bits as integers."""
        c = (x - self.center).astype(np.float32)
        return np.stack([((c @ p) > 0) @ self.weights for p in self.planes])

    def candidates(self, queries: np.ndarray, enough: int, least: int) -> Iterator[np.ndarray]:
        """Rows under the deepest common prefix depth at which all trees together hold at least `enough`, and of different rows at least `least`."""
        codes = self.codes(queries)
        trees, rows = self.sorted.shape
        enough, least = min(enough, trees * rows), min(least, rows)
        depth = np.full(len(queries), -1)
        lo, hi = np.zeros(codes.shape, dtype=np.int64), np.full(codes.shape, rows, dtype=np.int64)
        for d in range(self.bits, -1, -1):
            open_ = np.flatnonzero(depth < 0)
            if not len(open_):
                break
            self._ranges(codes, lo, hi, open_, d)
            done = (hi[:, open_] - lo[:, open_]).sum(axis=0) >= enough
            depth[open_[done]] = d
        seen = np.zeros(rows, dtype=bool)
        for q in range(len(queries)):
            while True:
                seen[:] = False
                for t in range(trees):
                    seen[self.order[t, lo[t, q] : hi[t, q]]] = True
                if depth[q] <= 0 or np.count_nonzero(seen) >= least:
                    break
                depth[q] -= 1  # all trees hold the same few rows, as those of the query itself
                self._ranges(codes, lo, hi, np.array([q]), depth[q])
            yield np.flatnonzero(seen)

    def _ranges(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, queries: np.ndarray, depth: int) -> None:
        low = np.uint64((1 << (self.bits - int(depth))) - 1)
        for t in range(len(codes)):
            c = codes[t, queries]
            lo[t, queries] = np.searchsorted(self.sorted[t], c & ~low)
            hi[t, queries] = np.searchsorted(self.sorted[t], c | low, side="right")


def _search(k: int, trees: int, bits: int, share: float, seed: int):
    def run(key: tuple, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(data) and len(queries):
            data = data.sort_values("vec_id", kind="stable")
            ids, x = data["vec_id"].to_numpy(), np.stack(data["v"].to_numpy()).astype(np.float64)
            qids, own, q = queries["vec_id"].to_numpy(), queries["own"].to_numpy(), np.stack(queries["v"].to_numpy()).astype(np.float64)
            forest = Forest(x, trees, bits, seed)
            for i, found in enumerate(forest.candidates(q, max(4 * k, int(share * len(x))) + trees, 4 * k + 1)):
                found = found[ids[found] != qids[i]]
                dist = np.sqrt(((x[found] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], dist))[:k]
                out += [(qids[i], own[i], ids[found[b]], dist[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "own", "vec_id", "score"]).astype({"query_id": "int64", "own": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, trees: int = 40, bits: int = 48, share: float = 0.8, shard_rows: int = 4096, query_rows: int = 8192, seed: int = 5
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its `k` nearest rows of `vectors` found, nearest first.

    score is the Euclidean distance in double precision, ties go to the smaller id. `share`: the ascent stops once the
    prefix ranges of all trees hold this many times the shard's rows, counted with repeats. A query's own id is no candidate.

    Null vectors, zero vectors and vectors with null or non-finite components take no part; vectors are compared
    within their dimension only. Rows with null ids take no part; ids that repeat each stay a candidate, but none with the query's id. Equal
    query rows are answered once; an id with several vectors is answered for each of them, with ranks of its own. Fewer than k candidates are all returned; empty tables give an empty result.
    """
    queries = vectors if queries is None else queries
    v = F.col(vector_col).cast("array<double>")
    sound = F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    take = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & sound).withColumn("dim", F.size("v"))
    data, asked = take(vectors), take(queries)
    shards, blocks = max(1, -(-data.count() // shard_rows)), max(1, -(-asked.count() // query_rows))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = data.select("dim", part(shards).alias("shard"), every(blocks).alias("block"), "vec_id", "v")
    asked = asked.distinct().select("dim", every(shards).alias("shard"), part(blocks).alias("block"), "vec_id", F.xxhash64("v").alias("own"), "v")
    key = ["dim", "shard", "block"]
    found = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k, trees, bits, share, seed), "query_id long, own long, vec_id long, score double")
    order = Window.partitionBy("query_id", "own").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
