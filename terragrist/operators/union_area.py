"""Areas of unions of polygons and of what two sets of polygons share, without merging shapes.

Polygons are cut at the squares of a grid, squares with many edges are cut in four again, and each square is measured by itself: between
the ends and crossings of its edges lie slabs in which edges are stacked, so that lengths covered by one set, the other, or both add up to areas. A square that lies
within a polygon of a set needs none of the edges of that set. Equal pieces count once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrist.functions.geometry import Polygon, Ring, extent, polygons, ring_area, write_polygon
from terragrist.sources.publish import work_folder
from terragrist.sources.vector import explode_parts

#: Edges of a square that are measured together.
EDGES = 192
#: How often a square is cut in four.
DEPTH = 24
#: Dense squares that may be broadcast; more are joined by a shuffle.
BROADCAST_SQUARES = 100_000
#: Slabs times edges that are looked at together.
CELLS = 1 << 20
_SQUARE = ["level", "gx", "gy"]


def _half(ring: Ring, axis: int, at: float, upper: bool) -> Ring:
    """The part of a ring on one side of a line. Bridges along the line have no area."""
    if not len(ring):
        return ring
    d = (ring[:, axis] - at) * (1 if upper else -1)
    if (d >= 0).all():
        return ring
    if (d <= 0).all():
        return ring[:0]
    nxt, dn = np.roll(ring, -1, axis=0), np.roll(d, -1)
    crossing = ((d > 0) & (dn < 0)) | ((d < 0) & (dn > 0))
    met = ring + (nxt - ring) * np.where(crossing, d / np.where(crossing, d - dn, 1.0), 0.0)[:, None]
    met[:, axis] = at
    both = np.stack([ring, met], axis=1).reshape(-1, 2)
    return both[np.stack([d >= 0, crossing], axis=1).ravel()]


def _inner_edges(rings: Polygon, x0: float, y0: float, size: float) -> int:
    """Edges that do not lie on the border of the square."""
    n = 0
    for r in rings:
        nxt = np.roll(r, -1, axis=0)
        on = np.zeros(len(r), bool)
        for axis, at in ((0, x0), (0, x0 + size), (1, y0), (1, y0 + size)):
            on |= (r[:, axis] == at) & (nxt[:, axis] == at)
        n += int((~on).sum())
    return n


def _cut_to(rings: Polygon, level: int, columns: range, rows: range) -> Iterator[tuple[int, int, int, int, bytes | None]]:
    """(level, gx, gy, edges, piece) for each square that the polygon meets; no piece where it covers the square."""
    size = 2.0**level

    def strip(some: Polygon, axis: int, g: int) -> Polygon:
        cut = [_half(_half(r, axis, g * size, True), axis, (g + 1) * size, False) for r in some]
        return [r for r in cut if len(r) > 2]

    for gx in columns:
        band = strip(rings, 0, gx)
        if not band:
            continue
        low, high = min(r[:, 1].min() for r in band), max(r[:, 1].max() for r in band)
        for gy in range(max(rows.start, int(np.floor(low / size))), min(rows.stop, int(np.floor(high / size)) + 1)):
            piece = strip(band, 1, gy)
            edges = _inner_edges(piece, gx * size, gy * size, size)
            if edges:
                yield level, gx, gy, edges, write_polygon(piece)
            elif sum(round(ring_area(r) / size**2) for r in piece) % 2:
                yield level, gx, gy, 0, None


def _open(r: Ring) -> Ring:
    return r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r


def _rows(found: list, left: list, names: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=[*_SQUARE, "edges", "piece"]).astype({"level": "int32", "gx": "int64", "gy": "int64", "edges": "int32"})
    for n, values in zip(names, zip(*left)):
        out[n] = values
    return out[[*names, *_SQUARE, "edges", "piece"]]


def _dealt(level: int | None, names: Sequence[str]):
    """Pieces of polygons (column g) for the squares of `level`, or of pieces for the four squares within theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, left = [], []
        for batch in batches:
            own = list(zip(*[batch[n] for n in names]))
            for k in range(len(batch)):
                if level is not None:
                    for rings in polygons(batch["g"].iat[k]):
                        rings = [o for o in map(_open, rings) if len(o) > 2 and np.isfinite(o).all()]
                        if not rings:
                            continue
                        points = np.concatenate(rings)
                        (a, c), (b, d) = np.floor(points.min(axis=0) / 2.0**level).astype(int), np.floor(points.max(axis=0) / 2.0**level).astype(int)
                        for row in _cut_to(rings, level, range(a, b + 1), range(c, d + 1)):
                            found.append(row)
                            left.append(own[k])
                            if len(found) == 4096:
                                yield _rows(found, left, names)
                                found, left = [], []
                else:
                    at, gx, gy, piece = (batch[n].iat[k] for n in (*_SQUARE, "piece"))
                    gx, gy = 2 * int(gx), 2 * int(gy)
                    if piece is None:
                        some = [(int(at) - 1, gx + x, gy + y, 0, None) for x in (0, 1) for y in (0, 1)]
                    else:
                        some = _cut_to([_open(r) for r in polygons(piece)[0]], int(at) - 1, range(gx, gx + 2), range(gy, gy + 2))
                    for row in some:
                        found.append(row)
                        left.append(own[k])
            if found:
                yield _rows(found, left, names)
                found, left = [], []

    return run


def covered(shapes: Sequence[tuple[bool, Polygon]]) -> tuple[float, float, float]:
    """Areas that polygons of the first set cover, those of the second, and both; rings count by the even-odd rule, polygon by polygon."""
    edges, of, second = [], [], []
    for k, (side, rings) in enumerate(shapes):
        for r in rings:
            e = np.concatenate([r, np.roll(r, -1, axis=0)], axis=1)
            e = e[e[:, 0] != e[:, 2]]
            e[e[:, 0] > e[:, 2]] = e[e[:, 0] > e[:, 2]][:, [2, 3, 0, 1]]
            edges.append(e)
            of += [k] * len(e)
            second += [side] * len(e)
    if not of:
        return 0.0, 0.0, 0.0
    e, of, second = np.concatenate(edges), np.array(of), np.array(second, bool)
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    ends = [e[:, [0, 2]].ravel()]
    for at in range(0, len(e), max(1, CELLS // len(e))):
        some = slice(at, at + max(1, CELLS // len(e)))
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base[None, :] - base[some, None]) / (slope[some, None] - slope[None, :])
        ends.append(x[(x > np.maximum(e[some, 0][:, None], e[:, 0])) & (x < np.minimum(e[some, 2][:, None], e[:, 2]))])
    xs = np.unique(np.concatenate(ends))
    total = np.zeros(3)
    step = max(1, CELLS // len(e))
    place = np.arange(len(e))[None, :]
    for at in range(0, len(xs) - 1, step):
        left, right = xs[at : at + step + 1][:-1], xs[at : at + step + 1][1:]
        mid = ((left + right) / 2)[:, None]
        on = (e[:, 0] < mid) & (mid < e[:, 2])
        y = np.where(on, e[:, 1] + slope * (mid - e[:, 0]), np.inf)
        order = np.argsort(y, axis=1, kind="stable")
        # an edge goes into its polygon if an even number of the polygon's edges lies below it
        mine = of[order]
        by_shape = np.argsort(mine, axis=1, kind="stable")
        grouped = np.take_along_axis(mine, by_shape, axis=1)
        begins = np.concatenate([np.ones((len(grouped), 1), bool), grouped[:, 1:] != grouped[:, :-1]], axis=1)
        rank = place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
        turn = np.empty_like(rank)
        np.put_along_axis(turn, by_shape, 1 - 2 * (rank % 2), axis=1)
        y = np.take_along_axis(y, order, axis=1)
        turn = np.where(np.isfinite(y), turn, 0)
        two = second[order]
        a, b = np.cumsum(np.where(two, 0, turn), axis=1)[:, :-1] > 0, np.cumsum(np.where(two, turn, 0), axis=1)[:, :-1] > 0
        with np.errstate(invalid="ignore"):
            tall = np.where(np.isfinite(y[:, 1:]), y[:, 1:] - y[:, :-1], 0.0)
        wide = right - left
        total += [((tall * x).sum(axis=1) * wide).sum() for x in (a, b, a & b)]
    return tuple(total.tolist())


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("first", "second", "both")]))
def _measured(pieces: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([covered([(bool(p["second"]), [_open(r) for r in polygons(p["piece"])[0]]) for p in some]) for some in pieces], columns=["first", "second", "both"])


def _few(spark, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SQUARES else df


def union_areas(first: DataFrame, second: DataFrame | None = None, *, by: Sequence[str] = (), geometry: str = "geom_wkb") -> DataFrame:
    """(by.., first, second, both): the area of the union of all polygons of `first`, of those of `second`, and of what both unions share, for each value of `by`.

    Polygons may be concave, have holes, overlap, be equal, share borders and cross themselves (the even-odd rule says what is inside; parts of a multipolygon are united). Rows with a null
    geometry, or one without area, give nothing; a value of `by` without any area has no row; null is a value of `by` like others. Without a column in `by` and without area there is no row.
    Where over EDGES edges run through one point, squares are cut DEPTH times; what is then still dense, some 1e-14 of the whole a square, counts as covered by the sets that reach it.
    """
    spark, keys = first.sparkSession, [f"k{i}" for i in range(len(by))]
    side = lambda d, of: d.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.lit(of).alias("second"), F.col(geometry).cast("binary").alias("g"))
    shapes = side(first, False) if second is None else side(first, False).unionByName(side(second, True))
    shapes = explode_parts(shapes.filter("g is not null"), "g")
    folder, names = work_folder(spark, "union"), [*keys, "second"]
    bounds = shapes.select(extent("g").alias("e"), (F.octet_length("g") / 16).alias("n")).filter("e is not null")
    low_x, low_y, high_x, high_y, edges = bounds.agg(F.min("e.xmin"), F.min("e.ymin"), F.max("e.xmax"), F.max("e.ymax"), F.sum("n")).first()
    reach = max(high_x - low_x, high_y - low_y) if edges else 0.0
    # squares of the size at which edges spread evenly would fill them by half; what is denser is cut again
    level = ceil(log2(reach / max(1.0, (2 * edges / EDGES) ** 0.5))) if reach > 0 else 0
    fields = [T.StructField(k, shapes.schema[k].dataType) for k in names]
    fields += [T.StructField("level", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("gx", "gy")], T.StructField("edges", T.IntegerType()), T.StructField("piece", T.BinaryType())]
    schema, square = T.StructType(fields), [*keys, *_SQUARE]

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def same(a: DataFrame, b: DataFrame, on: Sequence[str]):
        return [a[c].eqNullSafe(b[c]) for c in on]

    pieces, done = shapes.mapInPandas(_dealt(level, names), schema), []
    for depth in range(DEPTH + 1):
        pieces = kept(pieces.dropDuplicates([*names, *_SQUARE, "piece"]), f"pieces-{depth}")
        whole = pieces.filter("piece is null")
        parts = pieces.filter("piece is not null")
        parts = parts.join(whole, same(parts, whole, [*names, *_SQUARE]), "left_anti")
        pieces = kept(parts.unionByName(whole), f"needed-{depth}")
        dense = kept(pieces.groupBy(*square).agg(F.sum("edges").alias("n")).filter(F.col("n") > EDGES).drop("n"), f"dense-{depth}")
        if dense.isEmpty():
            done.append(pieces)
            break
        dense = _few(spark, dense)
        done.append(pieces.join(dense, same(pieces, dense, square), "left_anti"))
        more = pieces.join(dense, same(pieces, dense, square), "left_semi")
        if depth == DEPTH:
            done.append(more.select(*names, *_SQUARE, F.lit(0).alias("edges"), F.lit(None).cast("binary").alias("piece")).distinct())
        else:
            pieces = more.mapInPandas(_dealt(None, names), schema)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    covers = lambda two: F.coalesce(F.bool_or((F.col("second") == two) & F.col("piece").isNull()), F.lit(False))
    squares = every.groupBy(*square).agg(covers(False).alias("w1"), covers(True).alias("w2"), F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("second", "piece"))).alias("pieces"))
    full = F.pow(F.lit(4.0), F.col("level"))
    plain = squares.filter(F.size("pieces") == 0).select(*keys, F.when(F.col("w1"), full).otherwise(0.0).alias("first"), F.when(F.col("w2"), full).otherwise(0.0).alias("second"), F.when(F.col("w1") & F.col("w2"), full).otherwise(0.0).alias("both"))
    cut = squares.filter(F.size("pieces") > 0).withColumn("m", _measured.asNondeterministic()("pieces"))
    one, two = F.when(F.col("w1"), full).otherwise(F.col("m.first")), F.when(F.col("w2"), full).otherwise(F.col("m.second"))
    cut = cut.select(*keys, one.alias("first"), two.alias("second"), F.when(F.col("w1"), two).when(F.col("w2"), one).otherwise(F.col("m.both")).alias("both"))
    out = plain.unionByName(cut).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("first", "second", "both")])
    return out.filter("first > 0 or second > 0").select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "first", "second", "both")
