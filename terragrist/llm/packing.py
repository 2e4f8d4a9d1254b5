"""Length-bucketed packing with optimal buckets.

The counts of the exact lengths of all rows go to the driver, where dynamic programming chooses the bucket boundaries of least
total padding, without rounding. Different lengths are few: d of them take at least d * d / 2 tokens together, so a
table of 10^12 tokens has 1.5 million at most. Rows of a bucket are then dealt into batches of as many rows as fit
the token budget at the bucket's padded length. Places within a bucket come from counts per shard and row numbers
within a shard, so no task ever holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Equal rows that are placed as one; more are several such rows, in shards of their own.
PIECE = 65_536


def optimal_buckets(counts: Sequence[int], totals: Sequence[int], longest: Sequence[int], buckets: int) -> list[int]:
    """Last bin of each bucket, such that the sum of padding to each bucket's longest row is least; ties to earlier splits.

    counts, totals and longest: rows, summed lengths and largest length of each non-empty bin, by length. The padding of a bucket
    fulfils the quadrangle inequality, so the best split never moves back as the end grows. Each step halves the
    ends between those already solved, which costs buckets * n * log(n) time and memory in proportion to buckets * n.
    """
    n = len(counts)
    if not n:
        return []
    large = sum(int(x) for x in counts) * max(abs(int(x)) for x in longest) >= 1 << 61
    kind = object if large else np.int64  # Python's integers, where 64 bits could overflow
    c = np.concatenate([[0], np.cumsum(np.array(counts, dtype=kind))]).astype(kind)
    s = np.concatenate([[0], np.cumsum(np.array(totals, dtype=kind))]).astype(kind)
    m = np.array(longest, dtype=kind)
    best, came = c[1:] * m - s[1:], []
    for k in range(1, min(buckets, n)):
        best, split = _next_bucket(best, c, s, m, k)
        came.append(split)
    ends = [n - 1]
    for split in reversed(came):
        ends.append(int(split[ends[-1]]))
    return ends[::-1]


def _next_bucket(best: np.ndarray, c: np.ndarray, s: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of bins 0..j in k + 1 buckets, and the last bin of all but the last of them, for each j >= k."""
    n = len(m)
    after, split = best.copy(), np.zeros(n, dtype=np.int64)
    first, last = np.array([k]), np.array([n - 1])  # open ranges of ends, and the splits that they may have
    low, high = np.array([k - 1]), np.array([n - 2])
    while len(first):
        mid = (first + last) // 2
        top = np.minimum(high, mid - 1)
        size = top - low + 1
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(mid)), size)
        i, j = np.arange(len(of)) - start[of] + low[of], mid[of]
        total = best[i] + (c[j + 1] - c[i + 1]) * m[j] - (s[j + 1] - s[i + 1])
        least = np.minimum.reduceat(total, start)
        hit = np.flatnonzero(total == least[of])
        at = i[hit[np.unique(of[hit], return_index=True)[1]]]
        after[mid], split[mid] = least, at
        first, last, low, high = (np.concatenate(x) for x in ((first, mid + 1), (mid - 1, last), (low, at), (at, high)))
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return after, split


def pack(rows: DataFrame, id_col: str, length_col: str, *, buckets: int = 16, token_budget: int = 131072, shards: int = 1024) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot) for each row of `rows`.

    `bucket_len` is the padded length of the row's bucket, `batch` a number within the bucket. A batch holds
    max(1, token_budget // bucket_len) rows, so a row longer than the budget is a batch of its own. Null lengths count as
    0. Repeated rows and ids each take a place (null ids too). Rows of a bucket are placed by shard (from the id), then id, then length; of more than
    `PIECE` equal rows each further piece goes to the next shard. An empty table gives an empty result. Other columns are not looked at.
    """
    r = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n_tokens"))
    hist = r.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    lengths, counts = (hist.column(x).to_numpy() for x in ("n_tokens", "n"))
    order = lengths.argsort()
    lengths, counts = lengths[order], counts[order]
    bounds = [int(lengths[e]) for e in optimal_buckets(counts, counts * lengths, lengths, buckets)] or [0]
    bucket = F.lit(len(bounds) - 1)
    size = F.lit(bounds[-1])
    for k in reversed(range(len(bounds) - 1)):
        inside = F.col("n_tokens") <= bounds[k]
        bucket, size = F.when(inside, k).otherwise(bucket), F.when(inside, F.lit(bounds[k])).otherwise(size)
    shard = F.pmod(F.coalesce(F.col("doc_id") + F.expr(f"doc_id div {shards}"), F.col("n_tokens")), F.lit(shards))
    # Equal rows are one row with a count until the end, in pieces of bounded size, so that one id or many null ids cannot fill a shard or a row.
    r = r.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("all"))
    r = r.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(all - 1) div {PIECE}"))))
    r = r.withColumn("rows", F.least(F.lit(PIECE).cast("long"), F.col("all") - F.col("piece") * PIECE))
    r = r.select("doc_id", "n_tokens", "piece", "rows", bucket.cast("int").alias("bucket"), size.cast("long").alias("bucket_len"), F.pmod(shard + F.col("piece"), F.lit(shards)).alias("shard"))
    counts = r.groupBy("bucket", "shard").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = r.withColumn("end", F.sum("rows").over(within)).join(F.broadcast(offsets), ["bucket", "shard"])  # buckets * shards rows at most
    first = F.col("before") + F.col("end") - F.col("rows")
    placed = placed.withColumn("place", F.explode(F.sequence(first, first + F.col("rows") - 1)))
    per = F.greatest(F.lit(1), F.expr(f"{token_budget} div bucket_len"))
    placed = placed.withColumn("per", F.when(F.col("bucket_len") > 0, per).otherwise(F.lit(token_budget)))
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.expr("place div per").alias("batch"), (F.col("place") % F.col("per")).alias("slot"))


def with_byte_tokens(docs: DataFrame, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Length for byte-level models: one token a UTF-8 byte and one that ends the text; null texts are empty."""
    return docs.withColumn(out, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1)
