"""Polygons, points and pixels to grid cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrist.functions.cells import from_string, max_pixel_spacing_m, pixel_resolution, subsample_offsets, to_string
from terragrist.functions.geometry import extent, overlap_area, polygon_area
from terragrist.functions.hexgrid import boundary_wkb, point_to_cell, polygon_cells
from terragrist.operators.union_area import union_areas
from terragrist.sources.raster import reduce_cells
from terragrist.sources.vector import explode_parts, read_vector

MODES = ("centroid", "overlap", "contains", "exact_intersection")


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """The same rows in as many tasks as a shuffle has: a small file of polygons is one task's, and what is done with each of them is not small.

    With `rows_per_task`, for what is not much a row, they are counted and dealt to as many tasks as that asks for.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if rows_per_task is None else -(-max(1, df.count()) // rows_per_task)
    return df.repartition(n)


def index_polygons(df: DataFrame, resolution: int, mode: str = "overlap", *, geometry: str = "geom_wkb", cell: str = "cell", as_string: bool = False, keep_geometry: bool = False) -> DataFrame:
    """`df` with a row for each cell of its geometry.

    centroid: the cell of the centroid. overlap: cells that share area. contains: cells inside. exact_intersection: overlapping cells, with
    `intersection_ratio`, the share of the geometry in the cell (0 for a geometry without area). Parts of a multipolygon are
    indexed one by one, and a cell comes once a row of `df`.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    others = [c for c in df.columns if c != geometry]
    kept = [*others, geometry] if keep_geometry else others
    if mode == "centroid":
        e = df.withColumn("__e", extent(geometry))
        out = e.withColumn(cell, point_to_cell(resolution)(F.col("__e.cx"), F.col("__e.cy"))).select(*kept, cell)
    else:
        rows = spread(df).withColumn("__row", F.monotonically_increasing_id())
        cells = polygon_cells(resolution, "full" if mode == "contains" else "overlap")
        parts = explode_parts(rows.select("__row", geometry), geometry)
        found = parts.select("__row", F.explode(cells(geometry)).alias(cell)).distinct() if mode != "exact_intersection" else parts.select("__row", geometry, F.explode(cells(geometry)).alias(cell))
        if mode == "exact_intersection":
            found = found.groupBy("__row", cell).agg(F.sum(overlap_area(F.col(geometry), boundary_wkb(cell))).alias("__a"))
        out = rows.join(found, "__row")
        if mode == "exact_intersection":
            area = polygon_area(geometry)
            out = out.withColumn("__area", area).withColumn("intersection_ratio", F.when(F.col("__area") > 0, F.col("__a") / F.col("__area")).otherwise(0.0))
            kept = [*kept, "intersection_ratio"]
        out = out.select(*kept, cell)
    return out.withColumn(cell, to_string(F.col(cell))) if as_string else out


def polygon_candidates(polys: DataFrame, resolution: int, *, rid: str = "poly_rid", geometry: str = "geom_wkb") -> DataFrame:
    """(hex_id, poly_rid): cells that may share area with each polygon, once each."""
    parts = explode_parts(spread(polys.select(F.col(rid).alias("poly_rid"), F.col(geometry).alias("g"))), "g")
    cells = parts.select(F.explode(polygon_cells(resolution)("g")).alias("c"), "poly_rid")
    return cells.select(to_string(F.col("c")).alias("hex_id"), "poly_rid").distinct()


def cell_geometries(cells: DataFrame, hex_id: str = "hex_id", cache: DataFrame | None = None) -> DataFrame:
    """(hex_id, cell_wkb) of the distinct cells; those in `cache` are taken from it."""
    ids = cells.select(F.col(hex_id).alias("hex_id")).distinct()
    boundary = lambda text: boundary_wkb(F.coalesce(from_string(text), F.lit(0).cast("long")))
    if cache is None:
        return ids.select("hex_id", boundary(F.col("hex_id")).alias("cell_wkb"))
    known = cache.select("hex_id", "cell_wkb", F.lit(True).alias("known"))
    unknown = F.when(F.col("known").isNull(), F.col("hex_id"))
    # One join: of ids that are known no boundary is made.
    return ids.join(known.hint("merge"), "hex_id", "left").select("hex_id", F.coalesce("cell_wkb", boundary(unknown)).alias("cell_wkb"))


def sample_to_cells(points: DataFrame, resolution: int, how: str = "max", value: str = "value") -> DataFrame:
    """(cell, value): the largest or smallest value of the points of each cell."""
    at = points.select(point_to_cell(resolution)(F.col("longitude"), F.col("latitude")).alias("cell"), F.col(value).alias("value"))
    return reduce_cells(at.filter("cell is not null"), how)


def pixels_to_cells(pixels: DataFrame, pixel_x: float, pixel_y: float, *, resolution: int | None = None, max_subsample: float = 2.0, how: str = "max") -> DataFrame:
    """(cell, value) of pixels in degrees, each sampled on a centred grid fine enough for the resolution.

    Samples across a pixel: its size over the widest spacing that leaves no cell out, at most `max_subsample` rounded up. Without a
    resolution, the finest that these samples can fill is taken, for pixels at the equator.
    """
    size = max(pixel_x, pixel_y) * 111_320
    res = pixel_resolution(size, max_subsample) if resolution is None else resolution
    count = lambda d: max(1, min(math.ceil(d * 111_320 / max_pixel_spacing_m(res)), math.ceil(max_subsample)))
    shifts = [(x * pixel_x, y * pixel_y) for x in subsample_offsets(count(pixel_x)) for y in subsample_offsets(count(pixel_y))]
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in shifts]))
    spread = pixels.select("longitude", "latitude", "value", grid.alias("s")).select((F.col("longitude") + F.col("s.x")).alias("longitude"), (F.col("latitude") + F.col("s.y")).alias("latitude"), F.col("value").cast("double"))
    return sample_to_cells(spread, res, how)


def index_file(spark: SparkSession, path: str | list[str], fmt: str, resolution: int, mode: str = "overlap", **how) -> DataFrame:
    """index_polygons of a vector file."""
    return index_polygons(read_vector(spark, path, fmt), resolution, mode, **how)


def resolution_estimates(polys: DataFrame, resolutions: list[int], *, geometry: str = "geom_wkb") -> DataFrame:
    """(resolution, cell_count, error): cells over all polygons, those of several counted for each, and the area in which the union of the cells and the
    union of the polygons differ, over the area of the latter. Polygons may overlap, repeat and cross themselves; without any area there is no row.
    """
    wanted = F.explode(F.array(*[F.lit(r) for r in resolutions])).alias("resolution")
    shapes = polys.select(F.col(geometry).alias("g"))
    found = reduce(DataFrame.unionByName, [shapes.select(F.lit(r).alias("resolution"), F.explode(polygon_cells(r)("g")).alias("cell")) for r in resolutions])
    counted = found.groupBy("resolution", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = counted.select("resolution", boundary_wkb("cell").alias("g"))
    areas = union_areas(shapes.select(wanted, "g"), cells, by=["resolution"], geometry="g")
    error = ((F.col("first") + F.col("second") - 2 * F.col("both")) / F.col("first")).alias("error")
    return counted.groupBy("resolution").agg(F.sum("n").alias("cell_count")).join(areas.filter("first > 0"), "resolution").select("resolution", "cell_count", error)
