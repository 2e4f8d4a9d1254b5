"""GeoTIFF bands as a data source of Spark, read by ranges.

A partition is a run of tiles or strips. The driver's side reads the header only (first directory, a few KB); bounds go to the source by its option or as filters on
longitude and latitude that are pushed down, and tiles outside of them are neither planned nor read. Values are decoded in tasks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from terragrist.sources.raster import Affine, Bounds, pixel_window
from terragrist.sources.ranged import RangedFile, undo_float_predictor, undo_predictor, unpack

SCHEMA = "longitude double, latitude double, value float"
#: Pixels that a partition holds, about.
PARTITION_PIXELS = 4_000_000
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
_CODECS = {1: None, 5: "lzw", 8: "zlib", 32773: "packbits", 32946: "zlib", 50000: "zstd"}
#: Keys of the directory of geographic keys: model type, geographic and projected system.
_GEOGRAPHIC, _PROJECTED = 2048, 3072


@dataclass(frozen=True)
class Band:
    """What the header of a band says: grid, blocks and how they are packed. Offsets are kept by block, for the window only."""

    rows: int
    cols: int
    transform: tuple[float, float, float, float, float, float]
    crs: str | None
    kind: str
    bands: int
    planar: bool
    codec: str | None
    predictor: int
    block_rows: int
    block_cols: int
    tiled: bool
    nodata: float | None

    @property
    def affine(self) -> Affine:
        return Affine(*self.transform)

    @property
    def across(self) -> int:
        return -(-self.cols // self.block_cols)


class _Header:
    """Tags of the first directory, classic or big, read by ranges; long lists of offsets are read in parts."""

    def __init__(self, file: RangedFile) -> None:
        self.file = file
        head = file.read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack_from(order + "H", head, 2)[0] if order else 0
        if magic not in (42, 43):
            raise ValueError("no TIFF")
        self.order, self.big = order, magic == 43
        (at,) = struct.unpack_from(order + ("Q" if self.big else "I"), head, 8 if self.big else 4)
        count, entry = ("Q", 20) if self.big else ("H", 12)
        size = struct.calcsize(count)
        (n,) = struct.unpack(order + count, file.read(at, size))
        raw, fmt = file.read(at + size, n * entry), order + ("HHQ" if self.big else "HHI")
        self.where: dict[int, tuple[int, int, int, bytes | None]] = {}
        for i in range(n):
            tag, kind, m = struct.unpack_from(fmt, raw, i * entry)
            inline = raw[i * entry + struct.calcsize(fmt) : (i + 1) * entry]
            _, each = _TYPES.get(kind, ("B", 1))
            (offset,) = struct.unpack(order + ("Q" if self.big else "I"), inline)
            self.where[tag] = (kind, m, offset, inline if each * m <= len(inline) else None)

    def __contains__(self, tag: int) -> bool:
        return tag in self.where

    def count(self, tag: int) -> int:
        return self.where[tag][1]

    def get(self, tag: int, first: int = 0, n: int | None = None) -> tuple:
        """The values first.. of a tag; bytes for text."""
        kind, m, offset, inline = self.where[tag]
        fmt, each = _TYPES.get(kind, ("B", 1))
        n = m - first if n is None else min(n, m - first)
        data = inline[first * each : (first + n) * each] if inline is not None else self.file.read(offset + first * each, n * each)
        return data if kind == 2 else struct.unpack(self.order + fmt * n, data)

    def one(self, tag: int, default: int) -> int:
        return self.get(tag, 0, 1)[0] if tag in self.where else default


def read_band(file: RangedFile, assumed_crs: str | None = None) -> tuple[Band, _Header]:
    """The band's grid and packing. Without a reference system in the file the assumed one holds."""
    t = _Header(file)
    rows, cols = t.one(257, 0), t.one(256, 0)
    if 34264 in t:
        m = t.get(34264)
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in t and 33922 in t:
        (sx, sy), tie = t.get(33550)[:2], t.get(33922)
        transform = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    else:
        raise ValueError("the band has no place on the ground")
    codec = t.one(259, 1)
    if codec not in _CODECS:
        raise ValueError(f"compression {codec} is not supported")
    tiled = 322 in t
    block = (t.one(323, 0), t.one(322, 0)) if tiled else (min(rows, t.one(278, rows)), cols)
    kind = {1: "u", 2: "i", 3: "f"}[t.one(339, 1)] + str(t.one(258, 8) // 8)
    nodata = float(bytes(t.get(42113)).rstrip(b"\0 ")) if 42113 in t else None
    return Band(rows, cols, transform, _system(t) or assumed_crs, t.order + kind, t.one(277, 1), t.one(284, 1) == 2, _CODECS[codec], t.one(317, 1), *block, tiled, nodata), t


def _system(t: _Header) -> str | None:
    """EPSG code in the directory of geographic keys, if there is one."""
    if 34735 not in t:
        return None
    keys = t.get(34735)
    known = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = known.get(_PROJECTED) or known.get(_GEOGRAPHIC)
    return f"EPSG:{code}" if code and code < 32767 else None


def decode_block(raw: bytes, band: Band, index: int) -> np.ndarray:
    """(row, column, band) samples of one block; bands that are stored apart come one by one."""
    bands = 1 if band.planar else band.bands
    rows = band.block_rows if band.tiled else min(band.block_rows, band.rows - index // band.across * band.block_rows)
    kind, data = np.dtype(band.kind), unpack(raw, band.codec)
    if band.predictor == 3:
        return undo_float_predictor(data, rows, band.block_cols, bands, kind.itemsize)
    block = np.frombuffer(data, dtype=kind)[: rows * band.block_cols * bands].reshape(rows, band.block_cols, bands)
    return undo_predictor(block, band.predictor, band.kind[0])


@dataclass
class BlockRun(InputPartition):
    """Blocks first..last of one row of blocks."""

    row: int
    first: int
    last: int


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.number = options["path"], int(options.get("band", "1"))
        self.bounds: Bounds | None = tuple(json.loads(options["bounds"])) if options.get("bounds") else None
        self.rounded = options.get("window", "rounded") == "rounded"
        self.assumed = options.get("assumed_crs")
        self.limits: dict[str, list[float]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Lower and upper limits of longitude and latitude narrow the blocks; Spark applies all filters itself as well."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("longitude",), ("latitude",)):
                low = isinstance(f, (GreaterThan, GreaterThanOrEqual))
                name, was = f.attribute[0], self.limits.setdefault(f.attribute[0], [float("-inf"), float("inf")])
                self.limits[name] = [max(was[0], float(f.value)), was[1]] if low else [was[0], min(was[1], float(f.value))]
            yield f

    def _window(self, band: Band) -> tuple[int, int, int, int] | None:
        """Pixels in the bounds, narrowed to those whose centres lie within the pushed limits; None if no pixel is left."""
        window = pixel_window(band.affine, self.bounds, band.rows, band.cols, rounded=self.rounded)
        if not self.limits:
            return window
        inf, inverse = float("inf"), band.affine.inverse()
        (x0, x1), (y0, y1) = (self.limits.get(c, [-inf, inf]) for c in ("longitude", "latitude"))
        if x0 > x1 or y0 > y1:
            return None
        a, b, c, d = window
        if band.transform[1] == band.transform[3] == 0:
            cols = sorted(inverse.a * x + inverse.c for x in (x0, x1))
            rows = sorted(inverse.e * y + inverse.f for y in (y0, y1))
            clip = lambda v, lo, hi: int(max(lo, min(hi, np.floor(v)))) if abs(v) < inf else (lo if v < 0 else hi)
            a, b, c, d = clip(rows[0], a, b), clip(rows[1] + 1, a, b), clip(cols[0], c, d), clip(cols[1] + 1, c, d)
        return (a, b, c, d) if a < b and c < d else None

    def _opened(self) -> tuple[RangedFile, Band, _Header]:
        file = RangedFile(self.path)
        band, header = read_band(file, self.assumed)
        if band.crs not in (None, "EPSG:4326", "OGC:CRS84"):
            raise ValueError(f"{self.path} is in {band.crs}; bands must be in degrees (EPSG:4326)")
        if band.crs is None:
            raise ValueError(f"{self.path} names no reference system; give assumed_crs")
        if not 1 <= self.number <= band.bands:
            raise ValueError(f"band {self.number} of {band.bands}")
        return file, band, header

    def partitions(self) -> list[BlockRun]:
        file, band, _ = self._opened()
        file.close()
        window = self._window(band)
        if window is None:
            return []
        r0, r1, c0, c1 = window
        each = max(1, PARTITION_PIXELS // max(1, band.block_rows * band.block_cols))
        first, last = c0 // band.block_cols, (c1 - 1) // band.block_cols
        return [BlockRun(i, k, min(last, k + each - 1)) for i in range(r0 // band.block_rows, (r1 - 1) // band.block_rows + 1) for k in range(first, last + 1, each)]

    def read(self, run: BlockRun | None) -> Iterator[pa.RecordBatch]:
        file, band, header = self._opened()
        with file:
            window = self._window(band)
            if window is None or run is None:  # Spark asks once where nothing is planned
                return
            r0, r1, c0, c1 = window
            offsets, sizes = (324, 325) if band.tiled else (273, 279)
            plane = (self.number - 1) * band.across * -(-band.rows // band.block_rows) if band.planar else 0
            at = plane + run.row * band.across + run.first
            n = run.last - run.first + 1
            for k, (o, size) in enumerate(zip(header.get(offsets, at, n), header.get(sizes, at, n))):
                j, top, left = run.first + k, run.row * band.block_rows, (run.first + k) * band.block_cols
                a0, a1, b0, b1 = max(top, r0), min(top + band.block_rows, r1), max(left, c0), min(left + band.block_cols, c1)
                if not size:  # a block that was never written holds nothing
                    continue
                block = decode_block(file.read(o, size), band, run.row * band.across + j)
                v = block[a0 - top : a1 - top, b0 - left : b1 - left, 0 if band.planar else self.number - 1]
                raw = v.astype(np.float64)
                ok = np.isfinite(raw) & (True if band.nodata is None else (raw != band.nodata) & (v.astype(np.float32) != np.float32(band.nodata)))
                rr, cc = np.meshgrid(np.arange(a0, a1) + 0.5, np.arange(b0, b1) + 0.5, indexing="ij")
                x, y = band.affine.apply(cc[ok], rr[ok])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(v[ok].astype(np.float32))], ["longitude", "latitude", "value"])


class GeoTiffSource(DataSource):
    """format("terragrist_geotiff"): options path, band, bounds (JSON list), window (rounded or covering), assumed_crs."""

    @classmethod
    def name(cls) -> str:
        return "terragrist_geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(dict(self.options))


def read_geotiff(spark: SparkSession, path: str, bounds: Bounds | None = None, *, band: int = 1, mask: Column | None = None, assumed_crs: str | None = None) -> DataFrame:
    """(longitude, latitude, value float) of each finite pixel that is not nodata, tile by tile; only blocks within `bounds`, and within filters on longitude
    and latitude that follow, are read. `mask`: a condition on these columns that pixels must also meet.

    Strips and tiles, classic and big files, plain, deflate, LZW, zstd and PackBits, predictors 1 to 3, bands together or apart. Raises ValueError for bands that are
    not in degrees, for those without a reference system unless one is assumed, and for bounds that miss the band.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
    reader = spark.read.format("terragrist_geotiff").option("path", path).option("band", str(band))
    if bounds is not None:
        reader = reader.option("bounds", json.dumps(list(bounds)))
    if assumed_crs is not None:
        reader = reader.option("assumed_crs", assumed_crs)
    out = reader.load()
    return out if mask is None else out.filter(mask)
