"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrist.llm.shared import Scratch


def _mark(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set: rows and a wide sum of hashes."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def connected_components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (columns u, v): the smallest node that can be reached.

    Each round is two grouped minima (combined on the map side) and two equi-joins; it never gathers the
    neighbours of a node, so a node with very many links costs no more than its rows. Rounds needed grow
    with the logarithm of the longest path. Empty edges give an empty table; repeated edges and loops
    are allowed. Raises if `max_rounds` do not suffice.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now = edges.filter("u <> v").select(big.alias("u"), small.alias("v")).distinct()
    now = scratch.table(now, f"{name}-0")
    before = _mark(now)
    for i in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        star = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("w").alias("v")), F.struct("u", F.col("w").alias("v")))).alias("e"))
        star = star.select("e.u", "e.v").filter("u <> v").distinct()
        now = scratch.table(star, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
