"""Vector files and asset sources as DataFrames with a WKB column."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrist.functions.geometry import geojson_to_wkb, wkt_to_wkb
from terragrist.sources.publish import file_system
from terragrist.sources.shapefile import read_shapefile

FORMATS = ("geojson", "geoparquet", "parquet", "wkt", "wkb", "shapefile")
_GEOJSON = "type string, features array<struct<type: string, properties: map<string, string>, geometry: string>>"


def read_vector(spark: SparkSession, path: str | list[str], fmt: str, geometry: str = "geometry", *, keep_source: str | None = None) -> DataFrame:
    """All columns of the file and `geom_wkb`; `keep_source` names a copy of the source geometry (the text, for WKT).

    geojson: properties become string columns. geoparquet and parquet: `geometry` holds WKB. wkt and wkb: CSV with a header, the geometry as
    text or hexadecimal. shapefile: paths of .shp files with their .dbf.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "geojson":
        f = spark.read.schema(_GEOJSON).option("multiLine", "true").json(paths).select(F.explode("features").alias("f"))
        names = [r[0] for r in f.select(F.explode(F.map_keys("f.properties"))).distinct().collect()]
        df = f.select(*[F.col("f.properties")[n].alias(n) for n in sorted(names)], geojson_to_wkb(F.col("f.geometry")).alias("geom_wkb"))
        return df.withColumn(keep_source, F.col("geom_wkb")) if keep_source else df
    if fmt == "shapefile":
        df = reduce(DataFrame.unionByName, [read_shapefile(spark, p) for p in paths])
        return df.withColumn(keep_source, F.col("geom_wkb")) if keep_source else df
    if fmt in ("geoparquet", "parquet"):
        df = spark.read.option("mergeSchema", "true").parquet(*paths)
        df = df.withColumn(keep_source, F.col(geometry)) if keep_source else df
        return df.withColumnRenamed(geometry, "geom_wkb")
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(paths)
    df = df.withColumn(keep_source, F.col(geometry)) if keep_source else df
    wkb = wkt_to_wkb(F.col(geometry)) if fmt == "wkt" else F.unhex(F.col(geometry))
    return df.withColumn("geom_wkb", wkb).drop(geometry)


def read_union(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame:
    """Parquet files united by column name, with Hive partition columns below `base`."""
    reader = spark.read.option("mergeSchema", "true")
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def asset_source(spark: SparkSession, source) -> DataFrame:
    """A Path is Parquet, a string is SQL, a DataFrame is itself, and anything else a table in memory."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Path):
        return spark.read.parquet(str(source))
    if isinstance(source, str):
        return spark.sql(source)
    return spark.createDataFrame(source)


def measure(spark: SparkSession, path: str, geometry: str | None = None) -> tuple[int, int]:
    """(bytes, rows) of Parquet files under a path or glob; rows without a geometry do not count, if its column is named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    size = sum(fs.getContentSummary(s.getPath()).getLength() for s in found)
    df = spark.read.parquet(path)
    return size, (df.filter(F.col(geometry).isNotNull()) if geometry else df).count()


def geo_metadata(spark: SparkSession, path: str) -> dict | None:
    """What the footer of the first Parquet file says about geometry columns and their reference system; None where it says nothing readable."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    files = sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path").limit(1000).collect())
    if not files:
        return None
    # the file's last bytes are enough: the footer, its length and the mark
    fs, at = file_system(spark, files[0])
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        stream.seek(size - 8)
        length = int.from_bytes(bytes(stream.readNBytes(4)), "little")
        stream.seek(size - 8 - length)
        tail = bytes(stream.readNBytes(length + 8))
    finally:
        stream.close()
    found = pq.read_metadata(pa.BufferReader(b"PAR1" + tail)).metadata or {}
    try:
        return json.loads(found[b"geo"])
    except (KeyError, ValueError):
        return None


def explode_parts(df: DataFrame, geom: str = "geom_wkb") -> DataFrame:
    """One row for each polygon of a multipolygon."""
    from terragrist.functions.geometry import parts

    return df.withColumn(geom, F.explode(parts(F.col(geom).cast(T.BinaryType()))))
