"""Feature rows for vector tiling, and the settings of the external tiler that takes them."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrist.functions.geometry import geojson, reprojected
from terragrist.sources.vector import geo_metadata

GEOMETRY_NAMES = ("geometry", "geom", "wkb_geometry", "the_geom")


@dataclass(frozen=True)
class ZoomRange:
    minimum: int
    maximum: int

    def __post_init__(self) -> None:
        if not 0 <= self.minimum <= self.maximum <= 24:
            raise ValueError("zooms must satisfy 0 <= minimum <= maximum <= 24")

    @classmethod
    def of(cls, value: ZoomRange | int | Sequence[int]) -> ZoomRange:
        if isinstance(value, ZoomRange):
            return value
        if isinstance(value, int):
            return cls(value, value)
        values = list(value)
        return cls(*values) if len(values) == 2 else cls(min(values), max(values))


@dataclass(frozen=True)
class Layer:
    name: str
    rows: DataFrame
    zoom: ZoomRange
    properties: tuple[str, ...] | None = None
    geometry: str | None = None
    #: The reference system of the geometries, a code or a description; None for degrees.
    crs: str | int | Mapping | None = None

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, name: str, zoom: ZoomRange, properties: tuple[str, ...] | None = None) -> Layer:
        """A layer of Parquet files, whose footer says which column holds the geometry and in which reference system."""
        rows = spark.read.option("mergeSchema", "true").parquet(path)
        geometry, crs = geometry_and_crs(geo_metadata(spark, path), rows.columns)
        return cls(name, rows, zoom, properties, geometry, crs)


def geometry_column(columns: Sequence[str], named: str | None = None) -> str:
    """The named column, or the first usual name in any case."""
    lower = {c.lower(): c for c in reversed(columns)}
    for n in [named] if named else GEOMETRY_NAMES:
        if n.lower() in lower:
            return lower[n.lower()]
    raise ValueError(f"no geometry column in {list(columns)}")


def geometry_and_crs(said: Mapping | None, columns: Sequence[str]) -> tuple[str, str | Mapping | None]:
    """(geometry column, reference system) of a file: the primary column of its footer if there is such a column, else by name; no system where the footer names none."""
    primary = (said or {}).get("primary_column")
    column = primary if isinstance(primary, str) and primary in columns else geometry_column(columns)
    return column, (((said or {}).get("columns") or {}).get(column) or {}).get("crs")


def property_columns(columns: Sequence[str], geometry: str, allowed: Sequence[str] | None) -> list[str]:
    out = [c for c in columns if c.lower() not in (geometry.lower(), "bbox")]
    return out if allowed is None else [c for c in out if c in set(allowed)]


def feature(geometry: Column, properties: Column, layer: str, zoom: ZoomRange) -> Column:
    """A record separator, one GeoJSON feature with the tiler's layer tag, a newline."""
    tag = f'{{"layer":"{layer}","minzoom":{zoom.minimum},"maxzoom":{zoom.maximum}}}'
    return F.concat(F.char(F.lit(30)), F.lit('{"type":"Feature","tippecanoe":' + tag + ',"geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}\n"))


def layer_features(layer: Layer, precision: int = 6) -> DataFrame:
    """(feature) of rows with a geometry, in degrees; null properties are written as null."""
    df = layer.rows
    g = geometry_column(df.columns, layer.geometry)
    props = property_columns(df.columns, g, layer.properties)
    text = F.to_json(F.struct(*[F.col(p) for p in props]), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    return df.filter(F.col(g).isNotNull()).select(feature(geojson(reprojected(layer.crs)(F.col(g)), F.lit(precision)), text, layer.name, layer.zoom).alias("feature"))


def features(layers: Sequence[Layer], precision: int = 6) -> DataFrame:
    if not layers:
        raise ValueError("at least one layer is needed")
    return reduce(DataFrame.unionByName, [layer_features(x, precision) for x in layers])


#: Flags of the external tiler by kind of data; fixed values of its command line.
PRESETS = {
    "points": ("--drop-densest-as-needed", "--extend-zooms-if-still-dropping"),
    "polygons": ("--no-feature-limit", "--no-tile-size-limit", "--no-simplification-of-shared-nodes"),
    "polygons_capped": ("--coalesce-densest-as-needed", "--no-simplification-of-shared-nodes"),
    "areas": ("--coalesce-smallest-as-needed", "--detect-shared-borders"),
}


def tiler_command(preset: str, output: str, zoom: ZoomRange, *, binary: str = "tippecanoe", scratch: str | None = None) -> list[str]:
    if preset not in PRESETS:
        raise ValueError(f"preset must be one of {sorted(PRESETS)}")
    return [binary, "-o", output, f"-Z{zoom.minimum}", f"-z{zoom.maximum}", "--force", "--read-parallel", *PRESETS[preset], *(["-t", scratch] if scratch else [])]


def check_budget(input_bytes: int, scratch_bytes: int, factor: float = 30.0, safety: float = 0.9) -> None:
    """Raises if the tiler's scratch need, a multiple of the input, is over the safe part of the scratch disk."""
    need = input_bytes * factor
    if need > scratch_bytes * safety:
        raise ValueError(f"tiling needs about {need / 2**30:.1f} GiB of scratch, {scratch_bytes * safety / 2**30:.1f} GiB are safe")


def run_tiler(layers: Sequence[Layer], preset: str, output: str, *, binary: str = "tippecanoe", precision: int = 6) -> int:
    """Streams the features, one partition after the other, to the tiler on the driver; returns their number."""
    if shutil.which(binary) is None:
        raise FileNotFoundError(f"{binary} is not installed")
    rows = features(layers, precision)
    if rows.isEmpty():
        raise ValueError("there are no features to tile")
    zoom = ZoomRange(min(x.zoom.minimum for x in layers), max(x.zoom.maximum for x in layers))
    n = 0
    with subprocess.Popen(tiler_command(preset, output, zoom, binary=binary), stdin=subprocess.PIPE) as p:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            p.stdin.write(r[0].encode())
            n += 1
        p.stdin.close()
        if p.wait():
            raise RuntimeError(f"{binary} failed with status {p.returncode}")
    return n
