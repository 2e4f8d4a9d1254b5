"""Filter interaction audit: what each filter removes in every order that the filters can be applied in.

Every document is a mask of the filters that it fails. Documents are counted by part and mask, so that a part is 2^k cells
however many documents it has. A walk then visits all k! orders by swaps of two neighbours: a swap leaves all but two steps as they
were, and those two are summed anew from the cells. The removals of each filter are added up on the way, which gives
its share over all orders (its Shapley value times k!).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrist.llm.shared import Scratch

#: Filters at most: the result has k! * k rows a part.
MOST_FILTERS = 7
#: Parts that one task walks at once; 0.1 MB each for five filters.
PARTS_AT_ONCE = 64
_SPACE = r"[\x20\x09-\x0D]+"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def swaps(k: int) -> Iterator[int]:
    """Places i of the k! - 1 swaps (i, i + 1) that lead from the first order through all others: the last filter sweeps to and fro, and
    between two sweeps the others make one swap of their own."""
    if k < 2:
        return
    inner, down = swaps(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        own = next(inner, None)
        if own is None:
            return
        yield own + 1 if down else own
        down = not down


def walk(cells: np.ndarray, k: int) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """(order, kept after each step, removed in each step), for each order of the filters 0 to k - 1.

    `cells`: documents by (part, mask, measure), the first measure being all of them. kept: (part, step); removed: (part, step, measure).
    What is given is changed by the next step of the walk.
    """
    masks = np.arange(1 << k)

    def removed_by(f: int, before: int) -> np.ndarray:
        return cells[:, ((masks >> f & 1) == 1) & ((masks & before) == 0)].sum(axis=1)

    order = list(range(k))
    removed = np.stack([removed_by(f, (1 << f) - 1) for f in order], axis=1)
    kept = cells[:, :, 0].sum(axis=1)[:, None] - np.cumsum(removed[:, :, 0], axis=1)
    yield tuple(order), kept, removed
    for i in swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << f for f in order[:i])
        both = removed[:, i] + removed[:, i + 1]
        start = kept[:, i] + removed[:, i, 0]
        removed[:, i] = removed_by(order[i], before)
        removed[:, i + 1] = both - removed[:, i]  # the two remove the same documents together, whoever comes first
        kept[:, i] = start - removed[:, i, 0]
        yield tuple(order), kept, removed


def audit_cells(cells: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """The columns of the audit, each as (part, order, step); cells as for walk(), with good and toxic documents as second and third measure."""
    k, parts, orders = len(names), len(cells), factorial(len(names))
    masks = np.arange(1 << k)
    shape = (parts, orders, k)
    out = {c: np.zeros(shape, dtype=np.int64) for c in ("kept", "removed", "good_lost", "toxic_lost", "filter")}
    total = np.zeros((parts, k), dtype=np.int64)
    words = []
    for n, (order, kept, removed) in enumerate(walk(cells, k)):
        words.append("".join(names[f] for f in order))
        out["kept"][:, n], out["filter"][:, n] = kept, order
        for m, c in enumerate(("removed", "good_lost", "toxic_lost")):
            out[c][:, n] = removed[:, :, m]
        total[:, list(order)] += removed[:, :, 0]
    of = out.pop("filter")
    fails = np.stack([cells[:, (masks >> f & 1) == 1, 0].sum(axis=1) for f in range(k)], axis=1)
    alone = np.stack([cells[:, 1 << f, 0] for f in range(k)], axis=1)
    part = np.arange(parts)[:, None, None]
    out["redundant"] = fails[part, of] - out["removed"]
    out["unique_fails"], out["shapley"] = alone[part, of], total[part, of]
    out["filter_order"] = np.broadcast_to(np.array(words, dtype=object)[None, :, None], shape)
    out["step"] = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), shape)
    return out


def audit(docs: DataFrame, names: Sequence[str], *, part: str = "part", mask: str = "mask", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """The audit of documents that come with their part (string), the mask of the filters that they fail (bit f: names[f], one letter each), and
    whether they are good and toxic (booleans).

    One row per part, order and step, zeros included: kept after the step, removed in it, redundant (failing its filter but removed
    before), unique_fails (failing its filter only), good_lost and toxic_lost (of those removed), shapley (removed by its filter,
    summed over all orders). Null parts are '', null flags false, null masks 0. An empty table gives no rows. Other columns are not looked at.
    Documents are counted before they are shuffled, so a part of any size is 2^k rows a task at most.
    """
    k = len(names)
    if not 1 <= k <= MOST_FILTERS or any(len(n) != 1 for n in names) or len(set(names)) < k:
        raise ValueError(f"names must be 1 to {MOST_FILTERS} different letters")
    letters = "".join(names)
    flag = lambda c: F.count(F.when(F.coalesce(F.col(c), F.lit(False)), 1))
    cells = docs.groupBy(F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(mask), F.lit(0)).cast("int").alias("mask"))
    cells = cells.agg(F.count(F.lit(1)).alias("n"), flag(good).alias("good"), flag(toxic).alias("toxic"))
    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^k at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                counts = np.zeros((some.num_rows, 1 << k, 3), dtype=np.int64)
                for p, row in enumerate(some.column(1).to_pylist()):
                    for c in row:
                        counts[p, c["mask"]] = c["n"], c["good"], c["toxic"]
                cols = audit_cells(counts, letters)
                each = factorial(k) * k
                names_of = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), each)))
                kinds = [x.split() for x in AUDIT.split(", ")][1:]
                types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
                yield pa.RecordBatch.from_arrays([names_of, *[pa.array(cols[c].ravel(), types[t]) for c, t in kinds]], ["part", *[c for c, _ in kinds]])

    return rows.mapInArrow(run, AUDIT)


def _bits(*failing: Column) -> Column:
    out = F.lit(0)
    for f, c in enumerate(failing):
        out = out + F.when(c, 1 << f).otherwise(0)
    return out


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each document under the five filters A to E; null texts are empty.

    A: under 200 words. B: distinct words are under half of the words. C: over 2 % capitals A-Z. D: holds one of # $ % & * |. E: the
    same text stands under a smaller id. A null id is no smaller one and its row never fails E; rows that share id and text do not
    count against each other. A document is good, or toxic, if any row of `labels` with its id says so.

    Texts are read once; what is shuffled afterwards is an id, a SHA-256 of the text and the mask. Rows of one text meet only as one
    row a text that has several ids, and Spark splits the rows of a frequent one.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    four = _bits(n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]"))
    d = scratch.table(d.select("doc_id", "part", four.alias("four"), F.unhex(F.sha2("text", 256)).alias("of")), "masks")
    first = d.groupBy("of").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first").select("of", "first")
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    label = label.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    d = d.join(label, "doc_id", "left").join(first, "of", "left")
    return d.select("part", (F.col("four") + F.when(later, 16).otherwise(0)).alias("mask"), "good", "toxic")
