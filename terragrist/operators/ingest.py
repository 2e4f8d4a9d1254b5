"""Gridded return-period arrays to canonical hazard rows: fit each pixel, spread it over its cells."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrist.functions.fitting import FitPolicy, fit_curves
from terragrist.functions.geometry import extent, write_polygon
from terragrist.functions.hexgrid import polygon_cells
from terragrist.schema import COLUMNS, ROW_KEY, HazardMetadata, Source, conform
from terragrist.sources.publish import file_system, publish, read_bytes, write_bytes
from terragrist.sources.raster import Affine, Bounds, ZarrRaster, owning_tile, pixel_window, tile_bounds


@dataclass(frozen=True)
class IngestPolicy:
    """How pixels become rows."""

    resolution: int
    hazard_name: str
    producer: str
    version: str
    fit: FitPolicy = FitPolicy()
    tail: str = "upper"

    def __post_init__(self) -> None:
        if isinstance(self.resolution, bool) or not 0 <= self.resolution <= 15:
            raise ValueError("resolution must be between 0 and 15")
        if not self.hazard_name or not self.producer or not self.version:
            raise ValueError("hazard_name, producer and version must not be empty")
        if self.tail not in ("upper", "lower"):
            raise ValueError("tail must be upper or lower")

    def metadata(self, raster: ZarrRaster) -> HazardMetadata:
        m = raster.metadata
        return HazardMetadata(self.resolution, m.units, m.indicator_id, self.producer, self.version, (Source(self.producer, m.hazard_type, m.path or raster.path),))


def pixel_polygon(t: Affine):
    """A function of row and col columns that gives the pixel's WKB."""
    @F.pandas_udf(T.BinaryType())
    def run(row: pd.Series, col: pd.Series) -> pd.Series:
        corners = ((0, 1), (1, 1), (1, 0), (0, 0))
        return pd.Series([write_polygon([[t.apply(c + dx, r + dy) for dx, dy in corners]]) for r, c in zip(row, col)], dtype=object)

    return run


def source_id(path: str, row: Column, col: Column) -> Column:
    """Digest of the array's path and the pixel."""
    zero = F.char(F.lit(0))
    return F.sha2(F.concat(F.lit("raster"), zero, F.lit(path), zero, row.cast("string"), zero, col.cast("string")), 256)


def canonicalize(raster: ZarrRaster, policy: IngestPolicy, bounds: Bounds | None = None) -> DataFrame:
    """Canonical rows: pixels with too few finite knots are left out; fits that fail raise or are left out, as the policy says.

    One job for the whole window: chunks are decoded in tasks, knots grouped by pixel, fits spread over the cells that share area with the pixel.
    """
    m, path = raster.metadata, raster.metadata.path or raster.path
    curves = fit_curves(raster.knots(bounds, policy.tail), ["row", "col"], policy.fit)
    curves = curves.withColumn("source_geometry", pixel_polygon(raster.transform)("row", "col"))
    rows = curves.withColumn("cell_index", F.explode(polygon_cells(policy.resolution)("source_geometry")))
    rows = rows.withColumn("source_id", source_id(path, F.col("row"), F.col("col"))).withColumn("hazard_name", F.lit(policy.hazard_name)).withColumn("horizon", F.lit(m.year)).withColumn("pathway", F.lit(m.scenario))
    return conform(rows.select(*COLUMNS))


def with_tiles(rows: DataFrame, bounds: Bounds, degrees: float) -> DataFrame:
    """Rows with the number of the tile that owns their source pixel, for writing one directory a tile without repeats on shared edges."""
    return rows.withColumn("__e", extent("source_geometry")).withColumn("__x", F.col("__e.cx")).withColumn("__y", F.col("__e.cy")).withColumn("tile", owning_tile("__x", "__y", bounds, degrees)).drop("__e", "__x", "__y")


def write_tiles(rows: DataFrame, bounds: Bounds, degrees: float, path: str, *, mode: str = "errorifexists") -> DataFrame:
    """Canonical rows in one directory `tile=N` a tile, whole or not at all; tiles without rows have none. Gives the tiles with their rows."""
    tiled = with_tiles(rows, bounds, degrees).filter("tile is not null").repartition("tile").sortWithinPartitions("tile", *ROW_KEY)
    return publish(tiled, path, mode=mode, partition_by=("tile",)).groupBy("tile").agg(F.count(F.lit(1)).alias("rows"))


def ingest_tiles(raster: ZarrRaster, policy: IngestPolicy, bounds: Bounds, degrees: float, path: str) -> DataFrame:
    """Canonical rows of a raster tile by tile, each published by itself as `tile=N`; gives (tile, rows) of all tiles.

    A finished tile is noted in a log beside the tiles, so a run that was broken off goes on with the tiles that are left, and one that is run again does nothing. A tile
    reads only the chunks of its own window; tiles that miss the raster are noted without a job. Pixels go to the tile that owns their centre, so no row comes twice.
    """
    spark, path = raster.spark, path.rstrip("/")
    fs, log = file_system(spark, f"{path}/_finished")
    known = {int(f.getPath().getName()) for f in fs.listStatus(log)} if fs.exists(log) else set()
    for n, tile in enumerate(tile_bounds(bounds, degrees)):
        if n in known:
            continue
        rows = 0
        try:
            pixel_window(raster.transform, tile, *raster.shape[1:])
        except ValueError:  # the tile misses the raster
            pass
        else:
            found = with_tiles(canonicalize(raster, policy, tile), bounds, degrees).filter(F.col("tile") == n).drop("tile")
            rows = publish(found.repartitionByRange(*ROW_KEY).sortWithinPartitions(*ROW_KEY), f"{path}/tile={n}", mode="overwrite").count()
        write_bytes(spark, f"{path}/_finished/{n}", str(rows).encode())
    noted = [(int(f.getPath().getName()), int(read_bytes(spark, f.getPath().toString()))) for f in fs.listStatus(log)]
    return spark.createDataFrame(sorted(noted), "tile int, rows long")
