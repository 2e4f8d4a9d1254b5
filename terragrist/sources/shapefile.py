"""Shapefiles, read by Spark as bytes and decoded in tasks; one task a file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrist.functions.geometry import covers, ring_area, write_wkb


def _shape(raw: bytes) -> bytes | None:
    kind = struct.unpack_from("<i", raw)[0]
    if kind % 10 == 1:
        return write_wkb("Point", [np.frombuffer(raw, "<f8", 2, 4).reshape(1, 2)])
    if kind % 10 == 8:
        n = struct.unpack_from("<i", raw, 36)[0]
        return write_wkb("MultiPoint", [p.reshape(1, 2) for p in np.frombuffer(raw, "<f8", 2 * n, 40).reshape(n, 2)])
    if kind % 10 not in (3, 5):
        return None
    n, m = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{n}i", raw, 44), m]
    points = np.frombuffer(raw, "<f8", 2 * m, 44 + 4 * n).reshape(m, 2)
    rings = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind % 10 == 3:
        return write_wkb("LineString", rings) if n == 1 else write_wkb("MultiLineString", rings)
    outer = [[r] for r in rings if ring_area(r) <= 0]  # outlines run clockwise, holes the other way
    for hole in (r for r in rings if ring_area(r) > 0):
        home = next((p for p in outer if covers([[p[0]]], *hole[0])), None)
        if home is None:
            outer.append([hole])
        else:
            home.append(hole)
    return write_wkb("Polygon", outer) if len(outer) == 1 else write_wkb("MultiPolygon", outer)


def shapes(raw: bytes) -> Iterator[bytes | None]:
    at = 100
    while at + 8 <= len(raw):
        (words,) = struct.unpack_from(">i", raw, at + 4)
        yield _shape(raw[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words


def records(raw: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Field names and text values of a dBase table; deleted records stay, as shapes have them too."""
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields = []
    at = 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        p, row = head + i * size + 1, []
        for _, width in fields:
            row.append(raw[p : p + width].decode("utf-8", "replace").strip("\0 ") or None)
            p += width
        rows.append(row)
    return [f for f, _ in fields], rows


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Attributes as strings and `geom_wkb` of one or more shapefiles (`path` may be a glob that ends in .shp)."""
    shp = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"(?i)\.shp$", "").alias("k"), F.col("content").alias("shp"))
    dbf = spark.read.format("binaryFile").load(path[:-4] + ".dbf").select(F.regexp_replace("path", r"(?i)\.dbf$", "").alias("k"), F.col("content").alias("dbf"))
    both = shp.join(dbf, "k")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names, rows = records(d)
                maps = pa.array([list(zip(names, r)) for r in rows], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([maps, pa.array(list(shapes(a)), pa.binary())], ["attributes", "geom_wkb"])

    out = both.select("shp", "dbf").mapInArrow(decode, "attributes map<string, string>, geom_wkb binary")
    names = [r[0] for r in out.select(F.explode(F.map_keys("attributes"))).distinct().orderBy("col").collect()]
    return out.select(*[F.col("attributes")[n].alias(n) for n in names], "geom_wkb")
