"""Gridded arrays and GeoTIFF bands as DataFrames of pixels.

Files are listed and read by Spark (`binaryFile`), so any store that Spark reaches will do; a task decodes chunks or strips into Arrow
batches. The names of a window's chunks go into the pattern of the paths that are read, so other chunks are not opened.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrist.functions.curves import TabulatedCurve
from terragrist.sources.publish import file_system, read_bytes
from terragrist.sources.ranged import RangedFile, can_range, unpack

Bounds = tuple[float, float, float, float]


@dataclass(frozen=True)
class Affine:
    """x = a * column + b * row + c, y = d * column + e * row + f, for pixel corners."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if not det:
            raise ValueError("the transform cannot be inverted")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    def apply(self, x, y):
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f


def pixel_window(t: Affine, bounds: Bounds | None, rows: int, cols: int, *, rounded: bool = False) -> tuple[int, int, int, int]:
    """(first row, last row, first column, last column), half-open, that covers world bounds; raises if they miss the raster.

    `rounded`: offsets and lengths are rounded to whole pixels instead, as for GeoTIFF bands.
    """
    if bounds is None:
        return 0, rows, 0, cols
    x0, y0, x1, y1 = bounds
    if x0 >= x1 or y0 >= y1:
        raise ValueError("no pixel of the raster lies in the bounds")
    corners = [t.inverse().apply(x, y) for x in (x0, x1) for y in (y0, y1)]
    c0, c1 = math.floor(min(c for c, _ in corners) + 1e-9), math.ceil(max(c for c, _ in corners) - 1e-9)
    r0, r1 = math.floor(min(r for _, r in corners) + 1e-9), math.ceil(max(r for _, r in corners) - 1e-9)
    if rounded:
        near = lambda v: math.floor(v + 0.5)
        (ca, cb), (ra, rb) = ((min(v), max(v)) for v in ([c for c, _ in corners], [r for _, r in corners]))
        c0, r0 = near(ca), near(ra)
        c1, r1 = c0 + near(cb - ca), r0 + near(rb - ra)
    r0, r1, c0, c1 = max(0, r0), min(rows, r1), max(0, c0), min(cols, c1)
    if r0 >= r1 or c0 >= c1:
        raise ValueError("no pixel of the raster lies in the bounds")
    return r0, r1, c0, c1


@dataclass(frozen=True)
class RasterMetadata:
    hazard_type: str
    indicator_id: str
    scenario: str
    year: int
    units: str
    path: str = ""


#: Data types of version 3 as numpy names them.
_KINDS = {"float32": "f4", "float64": "f8", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8"}
#: Decoded chunks that a task keeps while it samples points.
CHUNKS_KEPT = 8


@dataclass(frozen=True)
class Codecs:
    """How the bytes of a chunk become its values: codecs in the order of packing, and the shape within."""

    shape: tuple[int, ...]
    dtype: str
    order: str
    names: tuple[str | None, ...]

    @classmethod
    def of(cls, shape: tuple[int, ...], kind: str, chain: list[dict]) -> Codecs:
        """From the codec chain of version 3; raises ValueError for codecs that are not known."""
        endian, names = "little", []
        for c in chain:
            said = c.get("configuration") or {}
            if c["name"] == "bytes":
                endian = said.get("endian", "little")
            elif c["name"] in ("gzip", "zstd", "blosc", "crc32c"):
                names.append(c["name"])
            else:
                raise ValueError(f"chunks in {c['name']} are not supported")
        return cls(tuple(shape), ("<" if endian == "little" else ">") + _KINDS[kind], "C", tuple(names))

    def bytes_of(self, raw: bytes) -> bytes:
        for name in reversed(self.names):
            raw = raw[:-4] if name == "crc32c" else unpack(raw, name)
        return raw

    def decode(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(self.bytes_of(raw), dtype=self.dtype).reshape(self.shape, order=self.order)


@dataclass(frozen=True)
class Shards:
    """Inner chunks of a shard: their codecs, and the index of (offset, bytes) that stands at one end of the file."""

    inner: Codecs
    grid: tuple[int, ...]
    index: Codecs
    at_end: bool

    @property
    def index_bytes(self) -> int:
        return 16 * math.prod(self.grid) + 4 * ("crc32c" in self.index.names)

    def places(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(self.index.bytes_of(raw), dtype=self.index.dtype).reshape(*self.grid, 2)

    def decode(self, raw: bytes, shape: tuple[int, ...], fill: float) -> np.ndarray:
        n = self.index_bytes
        places = self.places(raw[-n:] if self.at_end else raw[:n])
        out = np.full(shape, fill)
        for at in np.ndindex(*self.grid):
            o, size = (int(x) for x in places[at])
            if o != 0xFFFFFFFFFFFFFFFF:
                out[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, self.inner.shape))] = self.inner.decode(raw[o : o + size])
        return out


@dataclass(frozen=True)
class Layout:
    """Where the chunks of an array stand and what is in them; what a task needs to read them."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    prefix: str
    separator: str
    fill: float
    codecs: Codecs
    shards: Shards | None = None

    @classmethod
    def of(cls, path: str, info: dict) -> Layout:
        fill = info.get("fill_value")
        fill = float("nan") if fill in (None, "NaN") else float(fill)
        shape = tuple(info["shape"])
        if info.get("zarr_format") == 3:
            if info["chunk_grid"]["name"] != "regular" or info.get("storage_transformers"):
                raise ValueError("only regular grids of chunks are supported")
            chunks = tuple(info["chunk_grid"]["configuration"]["chunk_shape"])
            keys = info.get("chunk_key_encoding") or {"name": "default"}
            said = keys.get("configuration") or {}
            plain = keys["name"] == "default"
            chain, kind = info["codecs"], info["data_type"]
            where = dict(prefix="c" + said.get("separator", "/") if plain else "", separator=said.get("separator", "/" if plain else "."), fill=fill)
            if chain[0]["name"] != "sharding_indexed":
                return cls(path, shape, chunks, codecs=Codecs.of(chunks, kind, chain), **where)
            said = chain[0]["configuration"]
            inner = Codecs.of(tuple(said["chunk_shape"]), kind, said["codecs"])
            grid = tuple(c // i for c, i in zip(chunks, inner.shape))
            index = Codecs.of((), "uint64", said["index_codecs"])
            return cls(path, shape, chunks, codecs=inner, shards=Shards(inner, grid, index, said.get("index_location", "end") == "end"), **where)
        codec = info.get("compressor")
        name = codec["id"] if codec else None
        if name not in (None, "zlib", "gzip", "zstd", "blosc") or info.get("filters"):
            raise ValueError(f"chunks in {codec or info.get('filters')} are not supported")
        chunks = tuple(info["chunks"])
        return cls(path, shape, chunks, "", info.get("dimension_separator", "."), fill, Codecs(chunks, info["dtype"], info.get("order", "C"), (name,)))

    @property
    def flat(self) -> bool:
        return len(self.shape) == 2

    @property
    def chunk(self) -> tuple[int, int, int]:
        return (1, *self.chunks) if self.flat else self.chunks

    def key(self, k: int, i: int, j: int) -> str:
        return self.prefix + self.separator.join(str(x) for x in ((i, j) if self.flat else (k, i, j)))

    def decode(self, raw: bytes | None) -> np.ndarray:
        """(axis, row, column) values of a chunk; an absent one holds the fill value."""
        if raw is None:
            return np.full(self.chunk, self.fill)
        block = self.shards.decode(raw, self.chunks, self.fill) if self.shards else self.codecs.decode(raw)
        return block.reshape(self.chunk)


class PointReader:
    """Values at single pixels, for one task: opens only chunks with points, and of a shard only its index and the inner chunks with points."""

    def __init__(self, layout: Layout) -> None:
        self.layout, self.opened, self.bytes_read = layout, [], 0
        self._kept: OrderedDict[tuple, Callable[[int, int], np.ndarray]] = OrderedDict()

    def values(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """(point, axis) values."""
        n, (ck, cr, cc) = (1 if self.layout.flat else self.layout.shape[0]), self.layout.chunk
        out = np.empty((len(rows), n))
        i, j = rows // cr, cols // cc
        order = np.lexsort((j, i))
        cuts = np.flatnonzero(np.diff(i[order]) | np.diff(j[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            a, b = int(i[at[0]]), int(j[at[0]])
            for k in range(-(-n // ck)):
                k0, k1 = k * ck, min(n, (k + 1) * ck)
                out[at, k0:k1] = self._gather(k, a, b, rows[at] - a * cr, cols[at] - b * cc)[:, : k1 - k0]
        return out

    def _gather(self, k: int, i: int, j: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        get = self._kept.get((k, i, j))
        if get is None:
            get = self._kept[k, i, j] = self._open(k, i, j)
            while len(self._kept) > CHUNKS_KEPT:
                self._kept.popitem(last=False)
        else:
            self._kept.move_to_end((k, i, j))
        return get(r, c)

    def _open(self, k: int, i: int, j: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        layout = self.layout
        key = layout.key(k, i, j)
        file = RangedFile.open(f"{layout.path}/{key}")
        if file is None:
            return lambda r, c: np.full((len(r), layout.chunk[0]), layout.fill)
        self.opened.append(key)
        if layout.shards is None:
            with file:
                block = layout.decode(file.whole())
            self.bytes_read += file.bytes_read
            return lambda r, c: block[:, r, c].T
        shards, n = layout.shards, layout.shards.index_bytes
        with file:
            places = shards.places(file.read(file.size - n if shards.at_end else 0, n))
        self.bytes_read += n
        inner = (1, *shards.inner.shape) if layout.flat else shards.inner.shape
        places = places.reshape(1, *places.shape) if layout.flat else places

        def get(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            out = np.full((len(r), layout.chunk[0]), layout.fill)
            a, b = r // inner[1], c // inner[2]
            with RangedFile(f"{layout.path}/{key}") as again:
                for x, y in sorted({*zip(a.tolist(), b.tolist())}):
                    at = np.flatnonzero((a == x) & (b == y))
                    for z in range(places.shape[0]):
                        o, size = (int(v) for v in places[z, x, y])
                        if o != 0xFFFFFFFFFFFFFFFF:
                            block = shards.inner.decode(again.read(o, size)).reshape(inner)
                            out[at, z * inner[0] : (z + 1) * inner[0]] = block[:, r[at] - x * inner[1], c[at] - y * inner[2]].T
                self.bytes_read += again.bytes_read
            return out

        return get


@dataclass(frozen=True)
class ZarrRaster:
    """A stored array of two or three dimensions (leading axis, row, column), version 2 or 3 of the format; chunks plain or in zlib, gzip, zstd or blosc, version 3 also sharded."""

    spark: SparkSession
    path: str
    metadata: RasterMetadata
    info: dict = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str, metadata: RasterMetadata) -> ZarrRaster:
        path = path.rstrip("/")
        # names that begin with a dot are hidden from Spark's readers, not from its file systems
        there = lambda name: (lambda fs, at: fs.exists(at))(*file_system(spark, f"{path}/{name}"))
        read = lambda name: json.loads(read_bytes(spark, f"{path}/{name}"))
        if there(".zarray"):
            info, attributes = read(".zarray"), read(".zattrs")
        else:
            info = read("zarr.json")
            attributes = info.get("attributes") or {}
            if info.get("dimension_names"):
                attributes = {"dimensions": info["dimension_names"], **attributes}
        out = cls(spark, path, metadata, info, attributes)
        if len(info["shape"]) not in (2, 3):
            raise ValueError("arrays must have two or three dimensions")
        out.layout()
        out.axis_values()
        return out

    def layout(self) -> Layout:
        return Layout.of(self.path, self.info)

    @property
    def shape(self) -> tuple[int, int, int]:
        s = self.info["shape"]
        return (1, *s) if len(s) == 2 else tuple(s)

    @property
    def transform(self) -> Affine:
        return Affine(*[float(x) for x in self.attributes["transform_mat3x3"][:6]])

    def axis_name(self) -> str:
        dims = self.attributes.get("dimensions") or self.attributes.get("_ARRAY_DIMENSIONS") or ["index"]
        return self.attributes.get("index_name") or dims[0]

    def axis_values(self) -> list[float]:
        n = self.shape[0]
        dims = self.attributes.get("dimensions") or self.attributes.get("_ARRAY_DIMENSIONS") or [""]
        values = self.attributes.get("index_values") or self.attributes.get(f"{dims[0]}_values") or list(range(n))
        if len(values) != n:
            raise ValueError(f"{len(values)} axis values for an axis of {n}")
        return values

    def cells(self, bounds: Bounds | None = None) -> DataFrame:
        """(row, col, axis_index, value) of the window; values that are not finite are null, absent chunks hold the fill value."""
        return self._cells(*pixel_window(self.transform, bounds, *self.shape[1:]))

    def _cells(self, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
        layout, n = self.layout(), self.shape[0]
        ck, cr, cc = layout.chunk
        flat = layout.flat

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, i, j, raw in zip(*(c.to_pylist() for c in b.columns)):
                    block = layout.decode(raw)
                    a0, a1 = max(r0, i * cr), min(r1, (i + 1) * cr)
                    b0, b1 = max(c0, j * cc), min(c1, (j + 1) * cc)
                    k1 = min(n - k * ck, ck)
                    part = block[:k1, a0 - i * cr : a1 - i * cr, b0 - j * cc : b1 - j * cc].astype(float)
                    kk, rr, qq = np.meshgrid(np.arange(k1) + k * ck, np.arange(a0, a1), np.arange(b0, b1), indexing="ij")
                    value = part.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(rr.ravel().astype(np.int64)), pa.array(qq.ravel().astype(np.int64)), pa.array(kk.ravel().astype(np.int32)), pa.array(value, mask=~np.isfinite(value))], ["row", "col", "axis_index", "value"])

        seq = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
        grid = self.spark.range(1).select(seq(0, (n - 1) // ck).alias("k")).select("k", seq(r0 // cr, (r1 - 1) // cr).alias("i")).select("k", "i", seq(c0 // cc, (c1 - 1) // cc).alias("j"))
        schema = "row long, col long, axis_index int, value double"
        pattern = self._pattern(None if flat else (0, (n - 1) // ck), (r0 // cr, (r1 - 1) // cr), (c0 // cc, (c1 - 1) // cc))
        fs, at = file_system(self.spark, pattern)
        if not len(fs.globStatus(at) or []):
            return grid.select("k", "i", "j", F.lit(None).cast("binary").alias("content")).mapInArrow(decode, schema)
        place = F.split(F.regexp_extract("path", r"([0-9]+(?:[./][0-9]+)*)$", 1), r"[./]")
        files = self.spark.read.format("binaryFile").load(pattern)
        at_end = lambda x: F.element_at(place, x).cast("int")
        files = files.select((F.lit(0) if flat else at_end(-3)).alias("k"), at_end(-2).alias("i"), at_end(-1).alias("j"), "content")
        absent = grid.join(files.select("k", "i", "j"), ["k", "i", "j"], "left_anti").select("k", "i", "j", F.lit(None).cast("binary").alias("content"))
        return files.mapInArrow(decode, schema).unionByName(absent.mapInArrow(decode, schema))

    def _pattern(self, *ranges: tuple[int, int] | None) -> str:
        """A path pattern of the chunks in these ranges."""
        layout = self.layout()
        names = ["{" + ",".join(str(x) for x in range(r[0], r[1] + 1)) + "}" for r in ranges if r is not None]
        return f"{self.path}/{layout.prefix}{layout.separator.join(names)}"

    def scan(self, bounds: Bounds | None = None) -> DataFrame:
        """Pixel centres with axis and metadata columns."""
        return self.located(self.cells(bounds))

    def located(self, cells: DataFrame, *more: str) -> DataFrame:
        t, m = self.transform, self.metadata
        x, y = F.col("col") + 0.5, F.col("row") + 0.5
        lon, lat = (F.lit(p) * x + F.lit(q) * y + F.lit(o) for p, q, o in ((t.a, t.b, t.c), (t.d, t.e, t.f)))
        values = F.array(*[F.lit(v) for v in self.axis_values()])
        lits = {"hazard_type": m.hazard_type, "indicator_id": m.indicator_id, "scenario": m.scenario, "year": m.year, "units": m.units, "axis_name": self.axis_name(), "source_path": m.path or self.path}
        return cells.select("row", "col", lon.alias("longitude"), lat.alias("latitude"), "axis_index", F.get(values, F.col("axis_index")).alias("axis_value"), "value", *[F.lit(v).alias(k) for k, v in lits.items()], *more)

    def points(self, at: DataFrame, longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
        """All axis values at points, at the centres of their pixels, with the other columns of `at`; points outside raise, null points give no rows.

        Points are dealt to tasks by their pixels' order, evenly however many share a chunk; a task opens the chunks that it has points in, and no pixel becomes a row
        but those of points. Of a store that only Spark's readers reach, the points' window is read.
        """
        i = self.transform.inverse()
        _, rows, cols = self.shape
        x, y = F.col(longitude), F.col(latitude)
        col, row = (F.floor(F.lit(p) * x + F.lit(q) * y + F.lit(o)) for p, q, o in ((i.a, i.b, i.c), (i.d, i.e, i.f)))
        more = [c for c in at.columns if c not in (longitude, latitude, "row", "col", "value", "axis_index")]
        p = at.select(row.alias("row"), col.alias("col"), *more)
        r0, r1, c0, c1 = p.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
        if r0 is None:
            return self.located(self._cells(0, 1, 0, 1).join(p, ["row", "col"]), *more)
        if r0 < 0 or c0 < 0 or r1 >= rows or c1 >= cols:
            raise ValueError("a point lies outside the raster")
        if not can_range(self.path):
            return self.located(self._cells(r0, r1 + 1, c0, c1 + 1).join(p, ["row", "col"]), *more)
        return self.located(self._sampled(p.filter("row is not null and col is not null")), *more)

    def _sampled(self, points: DataFrame) -> DataFrame:
        """`points` (row, col, ...) with axis_index and value, a row for each place on the axis."""
        layout, n = self.layout(), self.shape[0]
        _, cr, cc = layout.chunk

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = PointReader(layout)
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    found = reader.values(b.column("row").to_numpy(), b.column("col").to_numpy()).ravel()
                    take = pa.array(np.repeat(np.arange(b.num_rows), n))
                    axis = pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows))
                    yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns], axis, pa.array(found, mask=~np.isfinite(found))], [*b.schema.names, "axis_index", "value"])

        schema = T.StructType([T.StructField(f.name, f.dataType) for f in points.schema.fields]).add("axis_index", T.IntegerType()).add("value", T.DoubleType())
        by_chunk = [F.floor(F.col("row") / cr), F.floor(F.col("col") / cc), F.col("row"), F.col("col")]
        return points.repartitionByRange(*by_chunk).sortWithinPartitions(*by_chunk).mapInArrow(sample, schema)

    def curves(self, bounds: Bounds | None = None) -> DataFrame:
        """One row a pixel with its whole axis curve, in axis order."""
        knots = F.sort_array(F.collect_list(F.struct("axis_index", "axis_value", "value")))
        return self.scan(bounds).groupBy("row", "col", "longitude", "latitude").agg(knots.alias("knots"))

    def _check_periods(self) -> None:
        if "return period" not in self.axis_name().lower():
            raise ValueError(f"axis {self.axis_name()!r} is no return period")

    def return_period_distribution(self, longitude: float, latitude: float, *, tail: str = "upper") -> TabulatedCurve:
        """The curve of one pixel, straight between its finite values. Raises if there are fewer than two of these, or if the axis is no return period."""
        self._check_periods()
        at = self.spark.createDataFrame([(float(longitude), float(latitude))], "longitude double, latitude double")
        knots = self.points(at).filter("value is not null").select(F.col("axis_value").cast("double"), "value").collect()  # as many as the axis has
        if len(knots) < 2:
            raise ValueError(f"{self.metadata.path or self.path} has {len(knots)} finite values there; a curve needs two")
        return TabulatedCurve.from_return_periods([k for k, _ in knots], [v for _, v in knots], tail)

    def knots(self, bounds: Bounds | None = None, tail: str = "upper") -> DataFrame:
        """(row, col, probability, value) for fitting; the axis must be a return period."""
        from terragrist.functions.fitting import knot_probability

        self._check_periods()
        return self.scan(bounds).filter("value is not null").select("row", "col", knot_probability(F.col("axis_value").cast("double"), tail).alias("probability"), "value")


_TIFF_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def tiff_tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first directory of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("no classic TIFF")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    tags = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        fmt, size = _TIFF_TYPES.get(kind, ("B", 1))
        where = at + 10 + 12 * i
        if size * n > 4:
            (where,) = struct.unpack_from(order + "I", raw, where)
        tags[tag] = raw[where : where + n] if kind == 2 else struct.unpack_from(order + fmt * n, raw, where)
    return order, tags


def scan_geotiff(spark: SparkSession, path: str, bounds: Bounds | None = None, band: int = 1, mask: Column | None = None) -> DataFrame:
    """(longitude, latitude, value float) of each finite pixel that is not nodata, for plain or deflated strips in degrees; `mask`: a condition on these columns that pixels must also meet."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                order, t = tiff_tags(raw)
                cols, rows = t[256][0], t[257][0]
                per = t.get(278, (rows,))[0]
                if t.get(259, (1,))[0] not in (1, 8, 32946) or t.get(317, (1,))[0] != 1 or 322 in t:
                    raise ValueError("only plain or deflated strips without predictor are supported")
                sx, sy = t[33550][:2]
                tie = t[33922]
                tr = (sx, tie[3] - tie[0] * sx, -sy, tie[4] + tie[1] * sy)
                affine = Affine(tr[0], 0, tr[1], 0, tr[2], tr[3])
                r0, r1, c0, c1 = pixel_window(affine, bounds, rows, cols, rounded=True)
                kind = {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]] + str(t.get(258, (8,))[0] // 8)
                bands = t.get(277, (1,))[0]
                nodata = float(bytes(t[42113]).rstrip(b"\0 ")) if 42113 in t else float("nan")
                for k, (o, n) in enumerate(zip(t[273], t[279])):
                    if (k + 1) * per > r0 and k * per < r1:
                        head = json.dumps([order + kind, bands, cols, k * per, min(rows, (k + 1) * per), r0, r1, c0, c1, tr, t.get(259, (1,))[0] != 1, None if nodata != nodata else nodata])
                        yield pa.RecordBatch.from_arrays([pa.array([head]), pa.array([raw[o : o + n]], pa.binary())], ["head", "strip"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for head, strip in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind, bands, cols, s0, s1, r0, r1, c0, c1, tr, packed, nodata = json.loads(head)
                data = np.frombuffer(zlib.decompress(strip) if packed else strip, dtype=kind)[: (s1 - s0) * cols * bands].reshape(s1 - s0, cols, bands)
                a0, a1 = max(s0, r0), min(s1, r1)
                v = data[a0 - s0 : a1 - s0, c0:c1, band - 1].astype(np.float32)
                rr, cc = np.meshgrid(np.arange(a0, a1), np.arange(c0, c1), indexing="ij")
                ok = np.isfinite(v) & ((v != np.float32(nodata)) if nodata is not None else True)
                yield pa.RecordBatch.from_arrays([pa.array(tr[1] + tr[0] * (cc[ok] + 0.5)), pa.array(tr[3] + tr[2] * (rr[ok] + 0.5)), pa.array(v[ok])], ["longitude", "latitude", "value"])

    strips = spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, "head string, strip binary")
    out = strips.repartition(F.xxhash64("head")).mapInArrow(decode, "longitude double, latitude double, value float")
    return out if mask is None else out.filter(mask)


def reduce_cells(values: DataFrame, how: str = "max", cell: str = "cell", value: str = "value") -> DataFrame:
    """Largest or smallest value of each cell; a cell with a NaN gives NaN, as in array arithmetic."""
    if how not in ("max", "min"):
        raise ValueError("reduce must be max or min")
    nan = F.max(F.isnan(value))
    best = (F.max if how == "max" else F.min)(F.when(~F.isnan(value), F.col(value)))
    return values.groupBy(cell).agg(F.when(nan, float("nan")).otherwise(best).alias(value))


def tile_bounds(bounds: Bounds, degrees: float) -> list[Bounds]:
    """Tiles of a box, south to north and west to east within, the last ones cut."""
    x0, y0, x1, y1 = bounds
    if degrees <= 0 or x0 >= x1 or y0 >= y1:
        raise ValueError("tiles need a positive size and bounds in order")
    steps = lambda a, b: [(a + i * degrees, min(b, a + (i + 1) * degrees)) for i in range(math.ceil((b - a) / degrees - 1e-12))]
    return [(a, c, b, d) for c, d in steps(y0, y1) for a, b in steps(x0, x1)]


def owning_tile(x: str, y: str, bounds: Bounds, degrees: float):
    """Number of the tile that owns a point: half-open tiles, with the box's outer edges going to the last ones; null points stay null."""
    x0, y0, x1, y1 = bounds
    nx, ny = (math.ceil((b - a) / degrees - 1e-12) for a, b in ((x0, x1), (y0, y1)))
    at = lambda c, a, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - F.lit(a)) / F.lit(degrees)))).cast("int")
    return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), at(y, y0, ny) * nx + at(x, x0, nx))
