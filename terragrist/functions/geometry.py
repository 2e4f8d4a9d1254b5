"""A small planar geometry kernel over WKB: codecs in numpy, and Arrow UDFs for the predicates and measures that SQL lacks.

Polygons are lists of rings, the first the outline and the others holes. Everything works on longitude and latitude as plane
coordinates, so areas are in square degrees.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrist.functions.projections import projection_of

Ring = np.ndarray
Polygon = list[Ring]


def read_wkb(data: bytes) -> tuple[str, list]:
    """(kind, parts): polygons for Polygon and MultiPolygon, an array of points for Point, MultiPoint and lines."""
    at = 0

    def take(fmt: str, order: str):
        nonlocal at
        out = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return out

    def points(n: int, order: str, dims: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=f"{order}f8", count=n * dims, offset=at).reshape(n, dims)[:, :2].astype(float)
        at += 8 * n * dims
        return out

    def geometry() -> tuple[str, list]:
        nonlocal at
        order = "<" if data[at] == 1 else ">"
        at += 1
        (code,) = take("I", order)
        if code & 0x20000000:
            take("I", order)
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        dims, code = max(dims, 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3)), code % 1000
        if code == 1:
            return "Point", [points(1, order, dims)]
        if code == 2:
            return "LineString", [points(take("I", order)[0], order, dims)]
        if code == 3:
            return "Polygon", [[points(take("I", order)[0], order, dims) for _ in range(take("I", order)[0])]]
        if code in (4, 5, 6):
            parts = [p for _ in range(take("I", order)[0]) for p in geometry()[1]]
            return {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[code], parts
        raise ValueError(f"geometry type {code} is not supported")

    return geometry()


def polygons(data: bytes | None) -> list[Polygon]:
    kind, parts = read_wkb(bytes(data)) if data else ("", [])
    return parts if kind in ("Polygon", "MultiPolygon") else []


def write_polygon(rings: list) -> bytes:
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for r in rings:
        a = np.asarray(r, dtype="<f8")
        if len(a) and (a[0] != a[-1]).any():
            a = np.concatenate([a, a[:1]])
        out += [struct.pack("<I", len(a)), a.tobytes()]
    return b"".join(out)


def write_wkb(kind: str, parts: list) -> bytes:
    if kind == "Point":
        return struct.pack("<BI2d", 1, 1, *parts[0][0])
    if kind == "LineString":
        return struct.pack("<BII", 1, 2, len(parts[0])) + np.asarray(parts[0], dtype="<f8").tobytes()
    if kind == "Polygon":
        return write_polygon(parts[0])
    single = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}[kind]
    code = {"MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}[kind]
    return struct.pack("<BII", 1, code, len(parts)) + b"".join(write_wkb(single, [p]) for p in parts)


def from_geojson(g: dict) -> bytes:
    kind, c = g["type"], g["coordinates"]
    arr = lambda x: np.asarray(x, dtype=float).reshape(-1, len(x[0]))[:, :2]
    if kind == "Point":
        return write_wkb(kind, [arr([c])])
    if kind == "LineString":
        return write_wkb(kind, [arr(c)])
    if kind == "Polygon":
        return write_wkb(kind, [[arr(r) for r in c]])
    if kind == "MultiPolygon":
        return write_wkb(kind, [[arr(r) for r in p] for p in c])
    if kind == "MultiPoint":
        return write_wkb(kind, [arr([p]) for p in c])
    return write_wkb(kind, [arr(line) for line in c])


def to_geojson(data: bytes, precision: int | None = None) -> str:
    kind, parts = read_wkb(data)
    rnd = (lambda a: np.round(a, precision).tolist()) if precision is not None else (lambda a: a.tolist())
    if kind == "Point":
        c = rnd(parts[0])[0]
    elif kind == "LineString":
        c = rnd(parts[0])
    elif kind == "Polygon":
        c = [rnd(r) for r in parts[0]]
    elif kind == "MultiPolygon":
        c = [[rnd(r) for r in p] for p in parts]
    elif kind == "MultiPoint":
        c = [rnd(p)[0] for p in parts]
    else:
        c = [rnd(p) for p in parts]
    return json.dumps({"type": kind, "coordinates": c}, separators=(",", ":"))


def from_wkt(text: str) -> bytes:
    """POINT, LINESTRING, POLYGON and their MULTI forms."""
    m = re.match(r"\s*(?:SRID=\d+;)?\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(?:Z|M|ZM)?\s*(\(.*\))\s*$", text, re.I | re.S)
    if not m:
        raise ValueError(f"cannot read WKT {text[:40]!r}")
    nested = re.sub(r"([-+0-9.eE]+(?:[ \t]+[-+0-9.eE]+)+)", lambda p: str([float(x) for x in p[1].split()]), m[3])
    c = json.loads(nested.replace("(", "[").replace(")", "]"))
    kind = ("Multi" if m[1] else "") + {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}[m[2].upper()]
    if kind == "Point":
        c = c[0]
    if kind == "MultiPoint":
        c = [p[0] if isinstance(p[0], list) else p for p in c]
    return from_geojson({"type": kind, "coordinates": c})


def ring_area(r: Ring) -> float:
    """Signed shoelace area, around the first vertex to keep digits."""
    if len(r) < 3:
        return 0.0
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2


def area(polys: list[Polygon]) -> float:
    return sum(max(0.0, abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:])) for p in polys if p)


def bounds(polys: list[Polygon]) -> tuple[float, float, float, float] | None:
    outer = [p[0] for p in polys if p and len(p[0])]
    if not outer:
        return None
    a = np.concatenate(outer)
    return (*a.min(axis=0).tolist(), *a.max(axis=0).tolist())


def centroid(polys: list[Polygon]) -> tuple[float, float] | None:
    """Area-weighted; of a degenerate polygon the mean of its vertices."""
    total = cx = cy = 0.0
    for p in polys:
        for i, r in enumerate(p):
            o = r[0]
            x, y = r[:, 0] - o[0], r[:, 1] - o[1]
            cross = x * np.roll(y, -1) - np.roll(x, -1) * y
            a = cross.sum() / 2
            sign = (1 if i == 0 else -1) * (1 if a >= 0 else -1)
            total += sign * a
            cx += sign * (((x + np.roll(x, -1)) * cross).sum() / 6 + a * o[0])
            cy += sign * (((y + np.roll(y, -1)) * cross).sum() / 6 + a * o[1])
    if total:
        return float(cx / total), float(cy / total)
    outer = [p[0] for p in polys if p]
    return tuple(np.concatenate(outer).mean(axis=0).tolist()) if outer else None


def covers(polys: list[Polygon], x: float, y: float) -> bool:
    """Point in polygon, boundary included."""
    for p in polys:
        inside = False
        for r in p:
            x0, y0 = r[:, 0], r[:, 1]
            x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
            cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
            on = (cross == 0) & (x >= np.minimum(x0, x1)) & (x <= np.maximum(x0, x1)) & (y >= np.minimum(y0, y1)) & (y <= np.maximum(y0, y1))
            if on.any():
                return True
            span = (y0 > y) != (y1 > y)
            right = np.where(y1 > y0, cross > 0, cross < 0)
            inside ^= bool(np.count_nonzero(span & right) % 2)
        if inside:
            return True
    return False


def clip_convex(subject: Ring, window: Ring) -> Ring:
    """Sutherland-Hodgman: the part of a simple ring inside a convex one. Bridges along the window's edge have no area."""
    w = window if ring_area(window) >= 0 else window[::-1]
    out = subject[:-1] if len(subject) > 1 and (subject[0] == subject[-1]).all() else subject
    w = w[:-1] if len(w) > 1 and (w[0] == w[-1]).all() else w
    for a, b in zip(w, np.roll(w, -1, axis=0)):
        if not len(out):
            break
        d = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, dn = np.roll(out, -1, axis=0), np.roll(d, -1)
        crossing = ((d > 0) & (dn < 0)) | ((d < 0) & (dn > 0))
        t = np.where(crossing, d / np.where(crossing, d - dn, 1.0), 0.0)
        met = out + (nxt - out) * t[:, None]
        both = np.stack([out, met], axis=1).reshape(-1, 2)
        out = both[np.stack([d >= 0, crossing], axis=1).ravel()]
    return out


def clip_area(polys: list[Polygon], window: list[Polygon]) -> float:
    """Area of the intersection with a convex cell."""
    if not window:
        return 0.0
    w, total = window[0][0], 0.0
    wx0, wy0 = w.min(axis=0)
    wx1, wy1 = w.max(axis=0)
    for p in polys:
        if not p or not len(p[0]):
            continue
        (px0, py0), (px1, py1) = p[0].min(axis=0), p[0].max(axis=0)
        if px0 >= wx1 or px1 <= wx0 or py0 >= wy1 or py1 <= wy0:
            continue
        part = abs(ring_area(clip_convex(p[0], w))) - sum(abs(ring_area(clip_convex(h, w))) for h in p[1:])
        total += max(0.0, part)
    return total


class _Cache:
    """The last few geometries parsed, as many rows share one."""

    def __init__(self, size: int = 64) -> None:
        self.size, self.seen = size, {}

    def get(self, data: bytes | None) -> list[Polygon]:
        if data is None:
            return []
        data = bytes(data)
        if data not in self.seen:
            if len(self.seen) >= self.size:
                self.seen.pop(next(iter(self.seen)))
            self.seen[data] = polygons(data)
        return self.seen[data]


#: Vertices that are looked at together.
TOGETHER = 1 << 18
_BOX_HEAD = struct.Struct("<BIII")


class Rings:
    """The rings of many polygons in one array of vertices, so that thousands of pairs are measured by the same numpy steps. A ring's last vertex is not its first."""

    def __init__(self, shapes: Sequence[bytes]) -> None:
        blocks: list[np.ndarray] = []
        found: list[tuple[np.ndarray, ...]] = []  # (shape, part, outer, start, count) of rings
        at = parts_ = 0

        def keep(shape, part, outer, start, count) -> None:
            found.append(tuple(np.atleast_1d(np.asarray(v, dtype=np.int64)) for v in (shape, part, outer, start, count)))

        sizes: dict[int, list[int]] = {}
        for i, g in enumerate(shapes):
            sizes.setdefault(len(g), []).append(i)
        for size, rows in sizes.items():
            n, odd = divmod(size - 13, 16)
            if n > 0 and not odd:
                # single rings of as many vertices, read as one array
                raw = np.frombuffer(b"".join([shapes[i] for i in rows]), dtype=np.uint8).reshape(len(rows), size)
                plain = (raw[:, :13] == np.frombuffer(_BOX_HEAD.pack(1, 3, 1, n), dtype=np.uint8)).all(axis=1)
                v = np.ascontiguousarray(raw[plain, 13:]).view("<f8").reshape(-1, n, 2)
                if len(v):
                    blocks.append(v.reshape(-1, 2))
                    k = np.arange(len(v))
                    closed = (v[:, 0] == v[:, -1]).all(axis=1) & (n > 1)
                    keep(np.asarray(rows)[plain], parts_ + k, np.ones(len(v)), at + k * n, n - closed)
                    at, parts_ = at + len(v) * n, parts_ + len(v)
                rows = np.asarray(rows)[~plain].tolist()
            for i in rows:
                for p in polygons(shapes[i]):
                    if not p or not len(p[0]):
                        continue
                    for k, r in enumerate(p):
                        if len(r):
                            blocks.append(r)
                            keep(i, parts_, k == 0, at, len(r) - (len(r) > 1 and (r[0] == r[-1]).all()))
                            at += len(r)
                    parts_ += 1
        if not found:
            keep(*[[]] * 5)
        shape, part, outer, start, count = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((np.arange(len(shape)), part, shape))
        self.part, self.outer, self.start, self.count = (c[order] for c in (part, outer.astype(bool), start, count))
        self.points = np.concatenate(blocks) if blocks else np.empty((0, 2))
        self.first = np.searchsorted(shape[order], np.arange(len(shapes)))
        self.number = np.bincount(shape, minlength=len(shapes))
        self.low, self.high = np.empty((parts_, 2)), np.empty((parts_, 2))
        rim = np.flatnonzero(self.outer)
        for v, n, k in self._blocks(rim):
            inside = np.arange(v.shape[1]) < n[:, None]
            self.low[self.part[rim[k]]] = np.where(inside[..., None], v, np.inf).min(axis=1)
            self.high[self.part[rim[k]]] = np.where(inside[..., None], v, -np.inf).max(axis=1)

    def bounds(self) -> list[tuple[float, float, float, float] | None]:
        """(x0, y0, x1, y1) of each shape."""
        part = np.flatnonzero(self.outer)
        shape = np.repeat(np.arange(len(self.number)), self.number)[part]
        low, high = np.full((len(self.number), 2), np.inf), np.full((len(self.number), 2), -np.inf)
        np.minimum.at(low, shape, self.low[self.part[part]])
        np.maximum.at(high, shape, self.high[self.part[part]])
        return [None if not n else (*a, *b) for n, a, b in zip(self.number.tolist(), low.tolist(), high.tolist())]

    def _blocks(self, ring: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vertices, their number, places in `ring`) of rings of about the same length, at most TOGETHER vertices at a time."""
        length = np.frexp(np.maximum(self.count[ring], 1) - 0.5)[1]
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            step = max(1, TOGETHER >> int(size))
            for at in range(0, len(rows), step):
                k = rows[at : at + step]
                n = self.count[ring[k]]
                yield self.points[self.start[ring[k]][:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)], n, k

    def _pairs(self, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, ring) of the rings of each pair's shape."""
        n = self.number[shape]
        pair = np.repeat(np.arange(len(shape)), n)
        return pair, np.repeat(self.first[shape] - (np.cumsum(n) - n), n) + np.arange(len(pair))

    def window_areas(self, shape: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of a shape and a convex window: the area that they share, and whether an edge of the shape meets the window's bounds. Holes are taken from their part."""
        total, close = np.zeros(len(shape)), np.zeros(len(shape), dtype=bool)
        w = np.where((ring_areas(windows) >= 0)[:, None, None], windows, windows[:, ::-1])
        low, high, whole = w.min(axis=1), w.max(axis=1), np.abs(ring_areas(w))
        pair, ring = self._pairs(shape)
        meet = ((self.low[self.part[ring]] < high[pair]) & (self.high[self.part[ring]] > low[pair])).all(axis=1)
        pair, ring = pair[meet], ring[meet]
        found = np.zeros(len(pair))
        for v, n, k in self._blocks(ring):
            own, nxt, there = pair[k], _next(v, n), np.arange(v.shape[1]) < n[:, None]
            near = (there & ((np.minimum(v, nxt) <= high[own][:, None]) & (np.maximum(v, nxt) >= low[own][:, None])).all(axis=2)).any(axis=1)
            close[own[near]] = True
            far = np.flatnonzero(~near)
            corner = w[own[far], 0]
            _, crossed = _crossings(v[far], nxt[far], there[far], corner[:, 0], corner[:, 1])
            found[k[far]] = np.where(crossed % 2 == 1, whole[own[far]], 0.0)
            found[k[near]] = np.abs(_clipped_areas(v[near], n[near], w[own[near]]))
        key, where = np.unique(pair * (len(self.low) + 1) + self.part[ring], return_inverse=True)
        outer = self.outer[ring]
        kept = np.bincount(where, found * outer, minlength=len(key)) - np.bincount(where, found * ~outer, minlength=len(key))
        total += np.bincount(key // (len(self.low) + 1), np.maximum(0.0, kept), minlength=len(shape))
        return total, close

    def cover(self, shape: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each pair's shape covers its point, boundary included."""
        pair, ring = self._pairs(shape)
        on, odd = np.zeros(len(pair), dtype=bool), np.zeros(len(pair))
        for v, n, k in self._blocks(ring):
            border, crossed = _crossings(v, _next(v, n), np.arange(v.shape[1]) < n[:, None], x[pair[k]], y[pair[k]])
            on[k], odd[k] = border, crossed
        key, where = np.unique(pair * (len(self.low) + 1) + self.part[ring], return_inverse=True)
        inside = np.bincount(where, odd, minlength=len(key)) % 2 == 1
        out = np.bincount(key // (len(self.low) + 1), inside, minlength=len(shape)) > 0
        out[pair[on]] = True
        return out


def _next(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The vertex after each one; after the last of n the first."""
    at = np.arange(1, v.shape[1] + 1)
    return np.take_along_axis(v, np.where(at < n[:, None], at, 0)[..., None], axis=1)


def _crossings(v: np.ndarray, nxt: np.ndarray, there: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a point lies on a ring's border, and how many edges its ray to the right crosses; as covers() has it."""
    x, y = x[:, None], y[:, None]
    x0, y0, x1, y1 = v[..., 0], v[..., 1], nxt[..., 0], nxt[..., 1]
    cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
    on = there & (cross == 0) & (x >= np.minimum(x0, x1)) & (x <= np.maximum(x0, x1)) & (y >= np.minimum(y0, y1)) & (y <= np.maximum(y0, y1))
    right = np.where(y1 > y0, cross > 0, cross < 0)
    return on.any(axis=1), (there & ((y0 > y) != (y1 > y)) & right).sum(axis=1)


def ring_areas(v: np.ndarray) -> np.ndarray:
    """Signed areas of rings of as many vertices, as ring_area has them."""
    r = v - v[:, :1]
    n = np.roll(r, -1, axis=1)
    return (r[..., 0] * n[..., 1] - n[..., 0] * r[..., 1]).sum(axis=1) / 2


def _clipped_areas(v: np.ndarray, n: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Signed areas of clip_convex of each ring (its first n vertices) and its counter-clockwise window, one side of all windows after another."""
    for a, b in zip(windows.transpose(1, 0, 2), np.roll(windows, -1, axis=1).transpose(1, 0, 2)):
        there = np.arange(v.shape[1]) < n[:, None]
        d = (b[:, :1] - a[:, :1]) * (v[..., 1] - a[:, 1:]) - (b[:, 1:] - a[:, 1:]) * (v[..., 0] - a[:, :1])
        nxt, dn = _next(v, n), _next(d[..., None], n)[..., 0]
        crossing = there & (((d > 0) & (dn < 0)) | ((d < 0) & (dn > 0)))
        t = np.where(crossing, d / np.where(crossing, d - dn, 1.0), 0.0)
        met = v + (nxt - v) * t[..., None]
        keep = np.stack([there & (d >= 0), crossing], axis=2).reshape(len(v), 2 * v.shape[1])
        both = np.stack([v, met], axis=2).reshape(len(v), 2 * v.shape[1], 2)
        n = keep.sum(axis=1)
        row, col = np.nonzero(keep)
        v = np.zeros((len(v), max(1, int(n.max(initial=0))), 2))
        v[row, (np.cumsum(keep, axis=1) - 1)[row, col]] = both[row, col]
    v = np.where((np.arange(v.shape[1]) < n[:, None])[..., None], v, v[:, :1])
    return np.where(n >= 3, ring_areas(v), 0.0)


def _distinct(shapes: pd.Series) -> tuple[Rings, np.ndarray]:
    """The rings of a batch's different geometries, and which one each row has."""
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(bytes(g), len(known)) for g in shapes], dtype=np.int64)
    return Rings(list(known)), which


def _windows(cells: Rings) -> np.ndarray:
    """Outlines of convex cells, as many vertices each: of shorter ones the last repeats. A cell without an outline is a point."""
    out = np.zeros((len(cells.number), max(1, int(cells.count.max(initial=1))), 2))
    some = np.flatnonzero(cells.number > 0)
    for v, n, k in cells._blocks(cells.first[some]):
        out[some[k], : v.shape[1]] = v
        out[some[k], v.shape[1] :] = v[:, -1:]
    return out


def _cell_areas(wkb: pd.Series, cell: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows without a null, area shared, whether an edge is near, area of the cell)."""
    ok = np.flatnonzero((wkb.notna() & cell.notna()).to_numpy())
    shapes, which = _distinct(wkb.iloc[ok])
    cells, own = _distinct(cell.iloc[ok])
    w = _windows(cells)
    shared, near = shapes.window_areas(which, w[own])
    return ok, shared, near, np.abs(ring_areas(w))[own]


@F.pandas_udf(T.BooleanType())
def covers_point(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(polygon WKB, longitude, latitude): boundary included; null if any is null."""
    for wkb, lon, lat in batches:
        out = np.full(len(wkb), None, dtype=object)
        ok = np.flatnonzero((wkb.notna() & lon.notna() & lat.notna()).to_numpy())
        shapes, which = _distinct(wkb.iloc[ok])
        out[ok] = shapes.cover(which, lon.to_numpy(float)[ok], lat.to_numpy(float)[ok])
        yield pd.Series(out)


@F.pandas_udf(T.DoubleType())
def overlap_area(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(polygon WKB, convex cell WKB): area of the intersection."""
    for wkb, cell in batches:
        out = np.full(len(wkb), np.nan)
        ok, shared, _, _ = _cell_areas(wkb, cell)
        out[ok] = shared
        yield pd.Series(out)


def share_of_cell(polys: list[Polygon], edges: np.ndarray, cell: list[Polygon]) -> float:
    """Share of a convex cell that polygons cover; `edges` are theirs (x0, y0, x1, y1).

    Where no edge meets the cell's bounds, the cell lies inside or outside as a whole, and one of its corners decides.
    """
    if not cell or not len(edges):
        return 0.0
    w = cell[0][0]
    (x0, y0), (x1, y1) = w.min(axis=0), w.max(axis=0)
    near = (np.minimum(edges[:, 0], edges[:, 2]) <= x1) & (np.maximum(edges[:, 0], edges[:, 2]) >= x0) & (np.minimum(edges[:, 1], edges[:, 3]) <= y1) & (np.maximum(edges[:, 1], edges[:, 3]) >= y0)
    if not near.any():
        return float(covers(polys, *w[0]))
    whole = area(cell)
    return clip_area(polys, cell) / whole if whole else 0.0


def _all_edges(polys: list[Polygon]) -> np.ndarray:
    rings = [np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for p in polys for r in p]
    return np.concatenate(rings) if rings else np.empty((0, 4))


@F.pandas_udf(T.DoubleType())
def _cell_share(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for wkb, cell in batches:
        out = np.full(len(wkb), np.nan)
        ok, shared, near, whole = _cell_areas(wkb, cell)
        share = np.divide(shared, whole, out=np.zeros(len(ok)), where=whole > 0)
        out[ok] = np.where(near, share, shared > 0)
        yield pd.Series(out)


#: (polygon WKB, convex cell WKB): share of the cell that the polygon covers. Filters on the result do not compute it again.
cell_share = _cell_share.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def covers_each(shapes: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """For each polygon WKB of a list, whether it covers the row's point, boundary included; null polygons cover all points, null points are covered by no polygon."""
    known: dict[bytes, list[Polygon]] = {}

    def one(g, px: float, py: float) -> bool:
        if g is None:
            return True
        if px != px or py != py:
            return False
        g = bytes(g)
        if g not in known:
            if len(known) >= 256:
                known.clear()
            known[g] = polygons(g)
        return covers(known[g], px, py)

    return pd.Series([None if s is None else [one(g, px, py) for g in s] for s, px, py in zip(shapes, x, y)], dtype=object)


@F.pandas_udf(T.DoubleType())
def polygon_area(wkb: pd.Series) -> pd.Series:
    return pd.Series([None if g is None else area(polygons(bytes(g))) for g in wkb], dtype=float)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax", "cx", "cy")]))
def extent(wkb: pd.Series) -> pd.DataFrame:
    """Bounds and centroid of polygons."""
    rows = []
    for g in wkb:
        p = polygons(bytes(g)) if g is not None else []
        b, c = bounds(p), centroid(p)
        rows.append((*(b or (None,) * 4), *(c or (None, None))))
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax", "cx", "cy"], dtype=float)


@F.pandas_udf(T.StringType())
def geojson(wkb: pd.Series, precision: pd.Series) -> pd.Series:
    return pd.Series([None if g is None else to_geojson(bytes(g), int(p)) for g, p in zip(wkb, precision)], dtype=object)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def parts(wkb: pd.Series) -> pd.Series:
    """The single polygons of a polygon or multipolygon."""
    return pd.Series([None if g is None else [write_polygon(p) for p in polygons(bytes(g))] for g in wkb], dtype=object)


@F.pandas_udf(T.BinaryType())
def wkt_to_wkb(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else from_wkt(t) for t in text], dtype=object)


@F.pandas_udf(T.BinaryType())
def geojson_to_wkb(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else from_geojson(json.loads(t)) for t in text], dtype=object)


def _packed(head: bytes, numbers: list[np.ndarray]) -> pd.Series:
    """Little-endian doubles of each row behind the same head; all rows of a batch in one array."""
    values = np.stack([np.asarray(x, dtype="<f8") for x in numbers], axis=1)
    rows = np.empty((len(values), len(head) + values.shape[1] * 8), dtype=np.uint8)
    rows[:, : len(head)] = np.frombuffer(head, dtype=np.uint8)
    rows[:, len(head) :] = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return pd.Series([r.tobytes() for r in rows], dtype=object)


@F.pandas_udf(T.BinaryType())
def box_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Rectangles, counter-clockwise."""
    return _packed(struct.pack("<BIII", 1, 3, 1, 5), [x0, y0, x1, y0, x1, y1, x0, y1, x0, y0])


@F.pandas_udf(T.BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    return _packed(struct.pack("<BI", 1, 1), [x, y])


#: Pairs of edges that are looked at together.
EDGE_PAIRS = 1 << 20


def _edges(polys: list[Polygon]) -> np.ndarray:
    """(x0, y0, x1, y1) of all edges that are not vertical, from left to right."""
    out = []
    for p in polys:
        for r in p:
            a, b = r, np.roll(r, -1, axis=0)
            e = np.concatenate([a, b], axis=1)
            e = e[e[:, 0] != e[:, 2]]
            flip = e[:, 0] > e[:, 2]
            e[flip] = e[flip][:, [2, 3, 0, 1]]
            out.append(e)
    return np.concatenate(out) if out else np.empty((0, 4))


def intersection_area(a: list[Polygon], b: list[Polygon]) -> float:
    """Area that two polygons share, concave ones and holes included.

    Vertical slabs between all vertices and all crossings of edges: within a slab both polygons are stacks of
    trapezoids that do not cross, so the shared length at its middle times its width is exact. Where many edges meet many, the
    range is halved at the middle vertex first, so memory stays bounded.
    """
    ea, eb = _edges(a), _edges(b)
    if not len(ea) or not len(eb):
        return 0.0
    lo, hi = max(ea[:, 0].min(), eb[:, 0].min()), min(ea[:, 2].max(), eb[:, 2].max())
    total, open_ = 0.0, [(lo, hi, ea, eb)]
    while open_:
        lo, hi, ea, eb = open_.pop()
        if lo >= hi:
            continue
        ea, eb = ea[(ea[:, 2] > lo) & (ea[:, 0] < hi)], eb[(eb[:, 2] > lo) & (eb[:, 0] < hi)]
        if not len(ea) or not len(eb):
            continue
        if len(ea) * len(eb) > EDGE_PAIRS:
            ends = np.concatenate([ea[:, [0, 2]].ravel(), eb[:, [0, 2]].ravel()])
            ends = ends[(ends > lo) & (ends < hi)]
            if len(ends):
                mid = np.partition(ends, len(ends) // 2)[len(ends) // 2]
                open_ += [(lo, mid, ea, eb), (mid, hi, ea, eb)]
                continue
        total += _slab_area(lo, hi, ea, eb)
    return total


def _slab_area(lo: float, hi: float, ea: np.ndarray, eb: np.ndarray) -> float:
    slope = lambda e: (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    sa, sb = slope(ea), slope(eb)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = ((eb[:, 1] - sb * eb[:, 0])[None, :] - (ea[:, 1] - sa * ea[:, 0])[:, None]) / (sa[:, None] - sb[None, :])
    inside = (x > np.maximum(ea[:, 0][:, None], eb[:, 0][None, :])) & (x < np.minimum(ea[:, 2][:, None], eb[:, 2][None, :]))
    xs = np.unique(np.concatenate([ea[:, [0, 2]].ravel(), eb[:, [0, 2]].ravel(), x[inside], [lo, hi]]))
    xs = xs[(xs >= lo) & (xs <= hi)]
    total = 0.0
    for left, right in zip(xs, xs[1:]):
        mid = (left + right) / 2
        cuts = []
        for e, s in ((ea, sa), (eb, sb)):
            on = (e[:, 0] < mid) & (e[:, 2] > mid)
            cuts.append(np.sort(e[on, 1] + s[on] * (mid - e[on, 0])))
        ya, yb = cuts
        n = 0.0
        i = j = 0
        while i + 1 < len(ya) and j + 1 < len(yb):
            n += max(0.0, min(ya[i + 1], yb[j + 1]) - max(ya[i], yb[j]))
            if ya[i + 1] < yb[j + 1]:
                i += 2
            else:
                j += 2
        total += n * (right - left)
    return total


@F.pandas_udf(T.DoubleType())
def _shared_area(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(polygon WKB, polygon WKB): area of the intersection."""
    cache = _Cache()
    for left, right in batches:
        yield pd.Series([None if x is None or y is None else intersection_area(cache.get(x), cache.get(y)) for x, y in zip(left, right)], dtype=float)


#: The same, computed once where filters follow.
shared_area = _shared_area.asNondeterministic()


def to_degrees(points: np.ndarray, crs: str | int | dict | None) -> np.ndarray:
    """Longitude and latitude of coordinates in a system that projections.projection_of knows."""
    projection = projection_of(crs)
    return points if projection is None else projection.points(points)


def reproject(data: bytes, crs: str | int | dict | None) -> bytes:
    """WKB in degrees."""
    kind, parts_ = read_wkb(data)
    move = lambda r: to_degrees(r, crs)
    moved = [[move(r) for r in p] for p in parts_] if "Polygon" in kind else [move(p) for p in parts_]
    return write_wkb(kind, moved)


def reprojected(crs: str | int | dict | None):
    """A function of a WKB column; the column itself where the system is in degrees."""
    if projection_of(crs) is None:
        return lambda wkb: F.col(wkb) if isinstance(wkb, str) else wkb

    @F.pandas_udf(T.BinaryType())
    def run(wkb: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else reproject(bytes(g), crs) for g in wkb], dtype=object)

    return run
