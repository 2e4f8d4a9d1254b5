"""Spatial join of two tables of boxes, by squares of several sizes.

The finest squares are chosen from a sample of the boxes' places: small enough that few boxes share one and few pairs are looked at for each box, and no smaller
than the boxes themselves. A box lies on the level whose squares are as large as it is, so it covers four squares there at most, however large it
is, and is also known to the coarser levels that boxes of the other side lie on. Two boxes meet on the coarser of their levels, in an equi-join on the square;
of the squares that they share, the one of their reference point (the lower left corner of what they have in common) gives
the pair, so no pair comes twice and nothing need be made distinct. Squares in which many boxes lie on top of each other are dealt to blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, frexp, inf, log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrist.sources.publish import work_folder

#: Boxes of a side that meet under one key at most, but for rows that are equal.
BLOCK = 2048
#: Pairs of boxes in a square that are looked at, for each box of both sides; squares are cut until there are no more, as far as the boxes' sizes allow.
PAIRS_A_BOX = 4
#: Boxes of each side whose places choose the finest squares.
SAMPLE = 50_000
#: Dense squares that may be broadcast (8 MB); more are joined by a shuffle.
BROADCAST_SQUARES = 200_000
#: Boxes in a file on the way.
ROWS_PER_FILE = 100_000
BOUNDS = ("xmin", "ymin", "xmax", "ymax")


def _side(df: DataFrame, id_col: str, on: Sequence[str], side: str) -> DataFrame:
    """(side_id, side_0.. of `on`, side_xmin.., side_level) of the rows with a box; level: the power of two that is as large as the box, null for points."""
    d = df.select(F.col(id_col).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{i}") for i, c in enumerate(on)], *[F.col(c).cast("double").alias(f"{side}_{c}") for c in BOUNDS])
    x0, y0, x1, y1 = (F.col(f"{side}_{c}") for c in BOUNDS)
    d = d.filter((x0 <= x1) & (y0 <= y1) & (F.greatest(F.abs(x0), F.abs(x1), F.abs(y0), F.abs(y1)) < inf))
    longest = F.greatest(x1 - x0, y1 - y0)
    raw = F.ceil(F.log2(longest)).cast("int")
    raw = raw + F.when(longest > F.pow(F.lit(2.0), raw), 1).otherwise(0)  # should the logarithm be rounded down to the power below
    return d.withColumn(f"{side}_level", F.when(longest > 0, raw))


def _finest(sample: np.ndarray, scale: float, smallest: int) -> int:
    """The level (squares of 2^level) at which no square of the sample's places holds more than BLOCK boxes, as far as that goes; not under `smallest`."""
    if not len(sample):
        return smallest
    reach = float(np.abs(sample).max())
    level = max(smallest, frexp(reach)[1] if reach else smallest)
    while level > smallest:
        _, n = np.unique(np.floor(sample / 2.0**level), axis=0, return_counts=True)
        if n.max() * scale <= BLOCK or n.max() == 1:
            break
        level -= 1
    return level


def _with_few_pairs(places: list[tuple[np.ndarray, float]], level: int, smallest: int) -> int:
    """The level at or under `level` at which the pairs of boxes in a square are few, by samples of both sides and the rows that a sampled one stands for."""
    (a, m), (b, n) = places
    most = PAIRS_A_BOX * (len(a) * m + len(b) * n)
    both = np.concatenate([a, b])
    while level > smallest:
        _, square = np.unique(np.floor(both / 2.0**level), axis=0, return_inverse=True)
        square = square.reshape(-1)
        if np.dot(np.bincount(square[: len(a)], minlength=square.max() + 1) * m, np.bincount(square[len(a) :], minlength=square.max() + 1) * n) <= most:
            break
        level -= 1
    return level


def _levels(left: DataFrame, right: DataFrame) -> tuple[int, list[int], list[int]]:
    """(finest level, levels of the left side, of the right side)."""
    summed = [
        d.agg(F.count(F.lit(1)).alias("n"), F.collect_set(f"{s}_level").alias("levels"), F.percentile_approx(f"{s}_level", 0.1).alias("low"), F.count_if(F.col(f"{s}_level").isNull()).alias("points"))
        for d, s in ((left, "l"), (right, "r"))
    ]
    a, b = summed[0].unionByName(summed[1]).collect()
    places = []
    for d, s, of in ((left, "l", a), (right, "r", b)):
        if of["n"]:
            share = min(1.0, SAMPLE / of["n"])
            some = d if share == 1.0 else d.sample(share, seed=1)
            t = some.select(((F.col(f"{s}_xmin") + F.col(f"{s}_xmax")) / 2).alias("x"), ((F.col(f"{s}_ymin") + F.col(f"{s}_ymax")) / 2).alias("y")).limit(2 * SAMPLE).toArrow()
            places.append((np.stack([t["x"].to_numpy(), t["y"].to_numpy()], axis=1), 1 / share))
    sizes = [x["low"] for x in (a, b) if x["low"] is not None]
    if any(x["points"] for x in (a, b)) or not sizes:
        reach = max((float(np.abs(p).max()) for p, _ in places if len(p)), default=1.0) or 1.0
        smallest = min([ceil(log2(reach)) - 40, *sizes])
    else:
        smallest = min(sizes)
    finest = max((_finest(p, scale, smallest) for p, scale in places), default=smallest)
    if len(places) == 2:
        finest = _with_few_pairs(places, finest, smallest)
    of = lambda x: sorted({max(finest, v) for v in x["levels"]} | ({finest} if x["points"] else set()))
    return finest, of(a), of(b)


def _entries(d: DataFrame, side: str, finest: int, own: list[int], other: list[int]) -> DataFrame:
    """A row for each square that a box is known to."""
    level = F.greatest(F.coalesce(F.col(f"{side}_level"), F.lit(finest)), F.lit(finest))
    d = d.withColumn(f"{side}_level", level)
    every = F.array(*[F.lit(x) for x in sorted({*own, *other})])
    coarser = F.array(*[F.lit(x) for x in other]) if other else F.array().cast("array<int>")
    known = F.filter(every, lambda x: (x == F.col(f"{side}_level")) | ((x > F.col(f"{side}_level")) & F.array_contains(coarser, x)))
    d = d.withColumn("level", F.explode(known))
    square = lambda c: _square(F.col(f"{side}_{c}"), F.col("level"))
    return d.withColumn("gx", F.explode(F.sequence(square("xmin"), square("xmax")))).withColumn("gy", F.explode(F.sequence(square("ymin"), square("ymax"))))


def _square(place: Column, level: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), level)).cast("long")


def dealt(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys under which they meet: no more than about BLOCK boxes of a side under one key.

    The boxes are written to the shared folder, as they are looked at four times, in files of bounded size: a few files of many boxes would be few tasks each time.
    """
    spark, folder = left.sparkSession, work_folder(left.sparkSession, "boxes")

    def kept(d: DataFrame, side: str) -> DataFrame:
        d.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{folder}/{side}")
        return spark.read.schema(d.schema).parquet(f"{folder}/{side}")

    a, b = kept(_side(left, left_id, on, "l"), "l"), kept(_side(right, right_id, on, "r"), "r")
    finest, la, lb = _levels(a, b)
    a, b = _entries(a, "l", finest, la, lb), _entries(b, "r", finest, lb, la)
    keys = [*[f"k{i}" for i in range(len(on))], "level", "gx", "gy"]
    named = lambda d, s: d.withColumnsRenamed({f"{s}_{i}": f"k{i}" for i in range(len(on))})
    a, b = named(a, "l"), named(b, "r")
    count = lambda d, n: d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    dense = count(a, "n_l").join(count(b, "n_r"), keys).filter("n_l > 1 or n_r > 1")
    few = dense.limit(BROADCAST_SQUARES + 1).count()
    if not few:
        return a, b, keys
    if few <= BROADCAST_SQUARES:
        dense = F.broadcast(dense)
    blocks = lambda d, s, o: (
        d.join(dense, keys, "left")
        .withColumn(f"b_{s}", F.coalesce(F.pmod(F.xxhash64(f"{s}_id", *[f"{s}_{c}" for c in BOUNDS]), F.col(f"n_{s}")).cast("int"), F.lit(0)))
        .withColumn(f"b_{o}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"n_{o}") - 1, F.lit(0)))))
        .drop("n_l", "n_r")
    )
    return blocks(a, "l", "r"), blocks(b, "r", "l"), [*keys, "b_l", "b_r"]


def box_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, *, on: Sequence[str] = ()) -> DataFrame:
    """(left_id, right_id) of all rows whose boxes (xmin, ymin, xmax, ymax) have a point in common, borders included, and whose columns `on` are equal.

    Every pair of rows comes once. Rows with a null, reversed or infinite box, or a null in `on`, meet nothing; a box may be a point. Rows
    that are equal each count. The work grows with the boxes and the pairs found, not with the rows of a value of `on`.
    """
    a, b, keys = dealt(left, right, left_id, right_id, on)
    c = F.col
    meet = (c("l_xmin") <= c("r_xmax")) & (c("l_xmax") >= c("r_xmin")) & (c("l_ymin") <= c("r_ymax")) & (c("l_ymax") >= c("r_ymin"))
    here = (c("level") == F.greatest("l_level", "r_level")) & (c("gx") == _square(F.greatest("l_xmin", "r_xmin"), c("level"))) & (c("gy") == _square(F.greatest("l_ymin", "r_ymin"), c("level")))
    # not broadcast by Spark's estimate, which is far under what boxes take once they are spelled out by square
    return a.join(b.hint("merge"), keys).filter(meet & here).select(c("l_id").alias(left_id), c("r_id").alias(right_id))
