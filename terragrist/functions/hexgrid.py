"""Positions on the public hexagonal grid: longitude and latitude to cell ids and back, vectorised in numpy.

The sphere is projected onto the twenty faces of an icosahedron (gnomonic), each with hexagonal coordinates i, j, k at 120 degrees.
A resolution has seven times the cells of the one above and alternates between two orientations. Only the placing of the
faces and of the 122 cells of resolution 0 is given by tables; how a base cell is turned on its neighbour faces is found from
geometry when the module is first used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrist.functions.geometry import Rings, ring_areas, write_polygon

# Fixed values of the public grid definition: face centres (latitude, longitude in radians) and the azimuth of each face's i axis.
FACE_CENTERS = np.array(
    [
        (0.803582649718989942, 1.248397419617396099), (1.307747883455638156, 2.536945009877921159), (1.054751253523952054, -1.347517358900396623), (0.600191595538186799, -0.450603909469755746),
        (0.491715428198773866, 0.401988202911306943), (0.172745327415618701, 1.678146885280433686), (0.605929321571350690, 2.953923329812411617), (0.427370518328979641, -1.888876200336285401),
        (-0.079066118549212831, -0.733429513380867741), (-0.230961644455383637, 0.506495587332349035), (0.079066118549212831, 2.408163140208925497), (0.230961644455383637, -2.635097066257444203),
        (-0.172745327415618701, -1.463445768309359553), (-0.605929321571350690, -0.187669323777381622), (-0.427370518328979641, 1.252716453253507838), (-0.600191595538186799, 2.690988744120037492),
        (-0.491715428198773866, -2.739604450678486295), (-0.803582649718989942, -1.893195233972397139), (-1.307747883455638156, -0.604647643711872080), (-1.054751253523952054, 1.794075294689396615),
    ]
)
FACE_AZIMUTHS = np.array(
    [
        5.619958268523939882, 5.760339081714187279, 0.780213654393430055, 0.430469363979999913, 6.130269123335111400, 2.692877706530642877, 2.982963003477243874, 3.532912002790141181, 3.494305004259568154, 3.003214169499538391,
        5.930472956509811562, 0.138378484090254847, 0.448714947059150361, 0.158629650112549365, 5.891865957979238535, 2.711123289609793325, 3.294508837434268316, 3.804819692245439833, 3.664438879055192436, 2.361378999196363184,
    ]
)
# Home face and position (face, i, j, k) of base cells 0 to 121.
HOMES = (
    (1, 1, 0, 0), (2, 1, 1, 0), (1, 0, 0, 0), (2, 1, 0, 0), (0, 2, 0, 0), (1, 1, 1, 0), (1, 0, 0, 1), (2, 0, 0, 0),
    (0, 1, 0, 0), (2, 0, 1, 0), (1, 0, 1, 0), (1, 0, 1, 1), (3, 1, 0, 0), (3, 1, 1, 0), (11, 2, 0, 0), (4, 1, 0, 0),
    (0, 0, 0, 0), (6, 0, 1, 0), (0, 0, 0, 1), (2, 0, 1, 1), (7, 0, 0, 1), (2, 0, 0, 1), (0, 1, 1, 0), (6, 0, 0, 1),
    (10, 2, 0, 0), (6, 0, 0, 0), (3, 0, 0, 0), (11, 1, 0, 0), (4, 1, 1, 0), (3, 0, 1, 0), (0, 0, 1, 1), (4, 0, 0, 0),
    (5, 0, 1, 0), (0, 0, 1, 0), (7, 0, 1, 0), (11, 1, 1, 0), (7, 0, 0, 0), (10, 1, 0, 0), (12, 2, 0, 0), (6, 1, 0, 1),
    (7, 1, 0, 1), (4, 0, 0, 1), (3, 0, 0, 1), (3, 0, 1, 1), (4, 0, 1, 0), (6, 1, 0, 0), (11, 0, 0, 0), (8, 0, 0, 1),
    (5, 0, 0, 1), (14, 2, 0, 0), (5, 0, 0, 0), (12, 1, 0, 0), (10, 1, 1, 0), (4, 0, 1, 1), (12, 1, 1, 0), (7, 1, 0, 0),
    (11, 0, 1, 0), (10, 0, 0, 0), (13, 2, 0, 0), (10, 0, 0, 1), (11, 0, 0, 1), (9, 0, 1, 0), (8, 0, 1, 0), (6, 2, 0, 0),
    (8, 0, 0, 0), (9, 0, 0, 1), (14, 1, 0, 0), (5, 1, 0, 1), (16, 0, 1, 1), (8, 1, 0, 1), (5, 1, 0, 0), (12, 0, 0, 0),
    (7, 2, 0, 0), (12, 0, 1, 0), (10, 0, 1, 0), (9, 0, 0, 0), (13, 1, 0, 0), (16, 0, 0, 1), (15, 0, 1, 1), (15, 0, 1, 0),
    (16, 0, 1, 0), (14, 1, 1, 0), (13, 1, 1, 0), (5, 2, 0, 0), (8, 1, 0, 0), (14, 0, 0, 0), (9, 1, 0, 1), (14, 0, 0, 1),
    (17, 0, 0, 1), (12, 0, 0, 1), (16, 0, 0, 0), (17, 0, 1, 1), (15, 0, 0, 1), (16, 1, 0, 1), (9, 1, 0, 0), (15, 0, 0, 0),
    (13, 0, 0, 0), (8, 2, 0, 0), (13, 0, 1, 0), (17, 1, 0, 1), (19, 0, 1, 0), (14, 0, 1, 0), (19, 0, 1, 1), (17, 0, 1, 0),
    (13, 0, 0, 1), (17, 0, 0, 0), (16, 1, 0, 0), (9, 2, 0, 0), (15, 1, 0, 1), (15, 1, 0, 0), (18, 0, 1, 1), (18, 0, 0, 1),
    (19, 0, 0, 1), (17, 1, 0, 0), (19, 0, 0, 0), (18, 0, 1, 0), (18, 1, 0, 1), (19, 2, 0, 0), (19, 1, 0, 0), (18, 0, 0, 0),
    (19, 1, 0, 1), (18, 1, 0, 0),
)
# Faces on which a pentagon is offset clockwise.
CLOCKWISE = {14: (2, 6), 24: (1, 5), 38: (3, 7), 49: (0, 9), 58: (4, 8), 63: (11, 15), 72: (12, 16), 83: (10, 19), 97: (13, 17), 107: (14, 18)}
_AP7_ROTATION = math.asin(math.sqrt(3 / 28))
_UNIT = 0.38196601125010500003
_SIN60 = math.sqrt(3) / 2

# Digits 1 to 6 as unit steps (k, j, jk, i, ik, ij), and their turn by 60 degrees counter-clockwise.
_STEPS = np.array([(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0)])
_CCW = np.array([0, 5, 3, 1, 6, 4, 2])
_CW = np.argsort(_CCW)


def _unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


_FACE_VECTORS = _unit_vectors(FACE_CENTERS[:, 0], FACE_CENTERS[:, 1])


def _azimuth(lat0, lon0, lat1, lon1):
    return np.arctan2(np.cos(lat1) * np.sin(lon1 - lon0), np.cos(lat0) * np.sin(lat1) - np.sin(lat0) * np.cos(lat1) * np.cos(lon1 - lon0))


def _to_plane(lat, lon, face, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates on a face, in cells of the resolution."""
    c = FACE_CENTERS[face]
    angle = np.arccos(np.clip((_unit_vectors(lat, lon) * _FACE_VECTORS[face]).sum(axis=-1), -1, 1))
    theta = FACE_AZIMUTHS[face] - _azimuth(c[..., 0], c[..., 1], lat, lon) - (_AP7_ROTATION if res % 2 else 0.0)
    r = np.tan(angle) / _UNIT * math.sqrt(7) ** res
    return r * np.cos(theta), r * np.sin(theta)


def _from_plane(x, y, face, res: int) -> tuple[np.ndarray, np.ndarray]:
    c = FACE_CENTERS[face]
    angle = np.arctan(np.hypot(x, y) * _UNIT / math.sqrt(7) ** res)
    az = FACE_AZIMUTHS[face] - np.arctan2(y, x) - (_AP7_ROTATION if res % 2 else 0.0)
    lat = np.arcsin(np.clip(np.sin(c[..., 0]) * np.cos(angle) + np.cos(c[..., 0]) * np.sin(angle) * np.cos(az), -1, 1))
    lon = c[..., 1] + np.arctan2(np.sin(az) * np.sin(angle) * np.cos(c[..., 0]), np.cos(angle) - np.sin(c[..., 0]) * np.sin(lat))
    return lat, (lon + math.pi) % (2 * math.pi) - math.pi


def _axial(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hexagon that holds a point, as whole i and j with k = 0: cube rounding of oblique coordinates."""
    j = y / _SIN60
    i = x + j / 2
    a = np.stack([i, -j, j - i], axis=-1)
    r = np.rint(a)
    d = np.abs(r - a)
    worst = d.argmax(axis=-1)
    fix = -(r.sum(axis=-1) - np.take_along_axis(r, worst[..., None], axis=-1)[..., 0])
    np.put_along_axis(r, worst[..., None], fix[..., None], axis=-1)
    return np.stack([r[..., 0], -r[..., 1]], axis=-1).astype(np.int64)


def _plane_of(ij: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ij[..., 0] - ij[..., 1] / 2, ij[..., 1] * _SIN60


def _up(ij: np.ndarray, odd: bool) -> np.ndarray:
    """The parent's hexagon; odd: the child's resolution is odd."""
    i, j = ij[..., 0], ij[..., 1]
    a, b = ((3 * i - j) / 7, (i + 2 * j) / 7) if odd else ((2 * i + j) / 7, (3 * j - i) / 7)
    return np.stack([np.rint(a), np.rint(b)], axis=-1).astype(np.int64)


def _down(ij: np.ndarray, odd: bool) -> np.ndarray:
    """The central child's hexagon."""
    i, j = ij[..., 0], ij[..., 1]
    return np.stack([2 * i + j, 3 * j - i] if odd else [3 * i - j, i + 2 * j], axis=-1)


_DIGIT_IJ = _STEPS[:, :2] - _STEPS[:, 2:]
_DIGIT_OF = {tuple(v): d for d, v in enumerate(_DIGIT_IJ.tolist())}


@lru_cache(maxsize=1)
def _bases() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(home faces, home ij, base cell by face and ij + 2, turns by face and ij + 2)."""
    homes = np.array(HOMES)
    face, ijk = homes[:, 0], homes[:, 1:]
    ij = ijk[:, :2] - ijk[:, 2:]
    lat, lon = _from_plane(*_plane_of(ij), face, 0)
    centers = _unit_vectors(lat, lon)
    base, turns = np.full((20, 5, 5), -1), np.zeros((20, 5, 5), dtype=int)

    def heading(f: int, at: np.ndarray, b: int, toward: np.ndarray) -> float:
        """Azimuth at the base cell's centre of a direction on face f."""
        x, y = _plane_of(at.astype(float))
        dx, dy = _plane_of(toward.astype(float) * 0.05)
        d = _unit_vectors(*_from_plane(x + dx, y + dy, np.array(f), 0)) - _unit_vectors(*_from_plane(x - dx, y - dy, np.array(f), 0))
        north = np.array([-math.sin(lat[b]) * math.cos(lon[b]), -math.sin(lat[b]) * math.sin(lon[b]), math.cos(lat[b])])
        east = np.array([-math.sin(lon[b]), math.cos(lon[b]), 0.0])
        return math.atan2(d @ east, d @ north)

    axis = np.array([1, 0])
    # around a pentagon digit 1 is missing; a face lies toward digit 3, 5 or 6, as the pentagon is at its i, j or k corner
    ring = [5, 4, 6, 2, 3]
    corner = {(2, 0): 3, (0, 2): 5, (-2, -2): 6}

    for f in range(20):
        for i in range(-2, 3):
            for j in range(-2, 3):
                if abs(i - j) > 2:
                    continue
                x, y = _plane_of(np.array([i, j]))
                la, lo = _from_plane(x, y, np.array(f), 0)
                d = np.linalg.norm(centers - _unit_vectors(la, lo), axis=1)
                b = int(d.argmin())
                if d[b] > 0.2:
                    continue
                base[f, i + 2, j + 2] = b
                if f == face[b]:
                    continue
                at = np.array([i, j])
                if ijk[b].max() == 2:
                    turn = (heading(face[b], ij[b], b, -ij[b]) - heading(f, at, b, -at)) % (2 * math.pi)
                    turns[f, i + 2, j + 2] = (4 + int(round(turn / (2 * math.pi / 5))) - ring.index(corner[i, j])) % 5
                else:
                    turn = (heading(face[b], ij[b], b, axis) - heading(f, at, b, axis)) % (2 * math.pi)
                    turns[f, i + 2, j + 2] = int(round(turn / (math.pi / 3))) % 6
    return face, ij, base, turns


def _pentagons() -> frozenset:
    return frozenset(i for i, (_, *ijk) in enumerate(HOMES) if ijk == [2, 0, 0])


def latlng_to_cell(lat: np.ndarray, lon: np.ndarray, res: int) -> np.ndarray:
    """Cell ids of positions in degrees; 0 where a coordinate is not finite."""
    ok = np.isfinite(lat) & np.isfinite(lon)
    la, lo = np.radians(np.where(ok, lat, 0.0)), np.radians(np.where(ok, lon, 0.0))
    face = (_unit_vectors(la, lo) @ _FACE_VECTORS.T).argmax(axis=1)
    ij = _axial(*_to_plane(la, lo, face, res))
    digits = np.zeros((len(la), res), dtype=np.int64)
    lookup = np.full((5, 5), 0)
    for (a, b), d in _DIGIT_OF.items():
        lookup[a + 2, b + 2] = d
    for r in range(res, 0, -1):
        above = _up(ij, r % 2 == 1)
        step = ij - _down(above, r % 2 == 1)
        digits[:, r - 1] = lookup[np.clip(step[:, 0], -2, 2) + 2, np.clip(step[:, 1], -2, 2) + 2]
        ij = above
    _, _, base, turns = _bases()
    at = np.clip(ij, -2, 2) + 2
    cell, turn = base[face, at[:, 0], at[:, 1]], turns[face, at[:, 0], at[:, 1]]
    five = np.isin(cell, list(_pentagons()))
    for n in range(1, 6):
        rows = (turn >= n) & ~five
        digits[rows] = _CCW[digits[rows]]
    if res and five.any():
        digits[five] = _turn_pentagons(digits[five], cell[five], face[five], turn[five])
    out = (1 << 59) | (res << 52) | (cell.astype(np.int64) << 45) | ((1 << 3 * (15 - res)) - 1)
    for r in range(1, res + 1):
        out |= digits[:, r - 1] << (3 * (15 - r))
    return np.where(ok, out, 0)


def _leading(digits: np.ndarray) -> np.ndarray:
    """The first digit of each row that is not 0."""
    return np.take_along_axis(digits, (digits > 0).argmax(axis=1)[:, None], axis=1)[:, 0]


def _turn_pentagons(digits: np.ndarray, cell: np.ndarray, face: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """A pentagon lacks the cells of digit 1, so what would fall there is turned past it."""
    clockwise = np.array([f in CLOCKWISE.get(c, ()) for c, f in zip(cell.tolist(), face.tolist())], dtype=bool)
    missing = _leading(digits) == 1
    digits = np.where((missing & clockwise)[:, None], _CW[digits], np.where((missing & ~clockwise)[:, None], _CCW[digits], digits))
    for n in range(1, 6):
        turned = _CCW[digits]
        turned = np.where((_leading(turned) == 1)[:, None], _CCW[turned], turned)
        digits = np.where((turns >= n)[:, None], turned, digits)
    return digits


@lru_cache(maxsize=1)
def _unfolds() -> dict[int, list[tuple[int, complex, complex]]]:
    """For each face its neighbours with the turn and shift that carry plane coordinates of resolution 0 over the shared edge."""
    corners = [(2, 0), (0, 2), (-2, -2)]
    flat = [complex(*(float(v) for v in _plane_of(np.array(c)))) for c in corners]
    where = np.array([[_unit_vectors(*_from_plane(*_plane_of(np.array(c, dtype=float)), np.array(f), 0)) for c in corners] for f in range(20)])
    out: dict[int, list[tuple[int, complex, complex]]] = {f: [] for f in range(20)}
    for f in range(20):
        for g in range(20):
            same = [(i, j) for i in range(3) for j in range(3) if np.linalg.norm(where[f, i] - where[g, j]) < 1e-6]
            if f != g and len(same) == 2:
                (i, j), (k, m) = same
                turn = (flat[m] - flat[j]) / (flat[k] - flat[i])
                out[f].append((g, turn, flat[j] - turn * flat[i]))
    return out


@lru_cache(maxsize=1)
def _neighbours() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbours, turns, shifts) of _unfolds, three a face."""
    return tuple(np.array([[way[k] for way in _unfolds()[f]] for f in range(20)]) for k in range(3))


def _carried(x: np.ndarray, y: np.ndarray, face: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(faces, x, y): plane coordinates on each of the three neighbours of a face, along a new last axis."""
    scale = math.sqrt(7) ** res * np.exp(-1j * (_AP7_ROTATION if res % 2 else 0.0))
    near, turn, shift = _neighbours()
    z = turn[face] * (x + 1j * y)[..., None] + shift[face] * scale
    return near[face], z.real, z.imag


def _nearest_face(lat, lon) -> np.ndarray:
    return (_unit_vectors(lat, lon) @ _FACE_VECTORS.T).argmax(axis=-1)


def _placed(cells: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(face, x, y, latitude, longitude) of the centres of cells of a resolution; angles in radians."""
    cells = np.asarray(cells, dtype=np.int64)
    base = (cells >> 45) & 127
    homes, ij, _, _ = _bases()
    five = np.isin(base, list(_pentagons()))
    good = (base < len(homes)) & (((cells >> 52) & 15) == res)
    digits = np.stack([(cells >> 3 * (15 - r)) & 7 for r in range(1, res + 1)], axis=1) if res else np.zeros((len(cells), 0), dtype=np.int64)
    face, at = np.zeros(len(cells), dtype=np.int64), np.zeros((4, len(cells)))
    good &= digits.max(axis=1, initial=0) < 7
    left = np.flatnonzero(good)
    # on a pentagon the digits past the missing sector are turned; which way shows in what leads back to the cell
    for turned in (np.arange(7), _CW, _CCW):
        place = ij[base[left]].copy()
        for r in range(res):
            place = _down(place, r % 2 == 0) + _DIGIT_IJ[turned[digits[left, r]]]
        x, y = (v[:, None].astype(float) for v in _plane_of(place))
        f = homes[base[left]][:, None]
        for _ in range(3):
            for k in range(f.shape[1]):
                lat, lon = _from_plane(x[:, k], y[:, k], f[:, k], res)
                back = latlng_to_cell(np.degrees(lat), np.degrees(lon), res) == cells[left]
                if back.any():
                    # the centre as the grid of its own face has it
                    hit, lat, lon = left[back], lat[back], lon[back]
                    face[hit] = _nearest_face(lat, lon)
                    px, py = _plane_of(_axial(*_to_plane(lat, lon, face[hit], res)).astype(float))
                    at[:, hit] = px, py, *_from_plane(px, py, face[hit], res)
                    left, f, x, y = left[~back], f[~back], x[~back], y[~back]
            if not len(left):
                break
            f, x, y = (v.reshape(len(left), -1) for v in _carried(x, y, f, res))
        left = left[five[left]]
    lost = np.ones(len(cells), dtype=bool)
    lost[good] = ~(np.abs(at[:, good]).sum(axis=0) > 0)
    if lost.any():
        raise ValueError(f"{int(cells[lost][0]):x} is no cell")
    return face, *at


def cell_center(cell: int) -> tuple[float, float]:
    """(latitude, longitude) in degrees."""
    *_, lat, lon = _placed(np.array([cell]), (int(cell) >> 52) & 15)
    return math.degrees(lat[0]), math.degrees(lon[0])


_CORNERS = np.radians(30 + 60 * np.arange(6))


def cell_boundary(cell: int) -> np.ndarray:
    """(longitude, latitude) of the corners in degrees, counter-clockwise; longitudes run on across the antimeridian."""
    return cell_boundaries(np.array([cell]))[0]


def cell_boundaries(cells: np.ndarray) -> list[np.ndarray]:
    """The boundary of each cell."""
    cells = np.asarray(cells, dtype=np.int64)
    out: list = [None] * len(cells)
    level = (cells >> 52) & 15
    for res in np.unique(level).tolist():
        rows = np.flatnonzero(level == res)
        for ring, row in zip(_boundaries(cells[rows], res), rows.tolist()):
            out[row] = ring
    return out


def _boundaries(cells: np.ndarray, res: int) -> list[np.ndarray]:
    face, x, y, lat0, lon0 = _placed(cells, res)
    below = (1 << 45) - (1 << 3 * (15 - res))
    five = np.isin((cells >> 45) & 127, list(_pentagons())) & ((cells & below) == 0)
    vx, vy = x[:, None] + np.cos(_CORNERS) / math.sqrt(3), y[:, None] + np.sin(_CORNERS) / math.sqrt(3)
    own = np.repeat(face[:, None], 6, axis=1)
    lat, lon = _from_plane(vx, vy, own, res)
    over = _nearest_face(lat, lon)
    row, corner = np.nonzero(over != own)
    if len(row):
        near, px, py = _carried(vx[row, corner], vy[row, corner], face[row], res)
        goal = near == over[row, corner][:, None]
        some, k = goal.any(axis=1), goal.argmax(axis=1)
        row, corner, k = row[some], corner[some], k[some]
        lat[row, corner], lon[row, corner] = _from_plane(px[some, k], py[some, k], over[row, corner], res)
    rings = list(_in_turn(lat, lon, lat0[:, None], lon0[:, None]))
    for i in np.flatnonzero(five).tolist():
        rings[i] = _pentagon(int(face[i]), float(x[i]), float(y[i]), float(lat0[i]), float(lon0[i]), res)
    return rings


def _in_turn(lat: np.ndarray, lon: np.ndarray, lat0, lon0) -> np.ndarray:
    """Corners in degrees, in turn around their centre."""
    lon = lon0 + (lon - lon0 + math.pi) % (2 * math.pi) - math.pi
    turn = np.argsort(np.arctan2(lat - lat0, (lon - lon0) * np.cos(lat0)), axis=-1)
    return np.take_along_axis(np.degrees(np.stack([lon, lat], axis=-1)), turn[..., None], axis=-2)


def _pentagon(face: int, x: float, y: float, lat0: float, lon0: float, res: int) -> np.ndarray:
    """The corners that each face has of a pentagon of its own (twelve a resolution)."""
    faces, points = [(face, x, y)], []
    for _ in range(2):
        faces += [(int(g), float(a), float(b)) for f, px, py in faces for g, a, b in zip(*_carried(np.array(px), np.array(py), np.array(f), res))]
    v0 = _unit_vectors(np.array(lat0), np.array(lon0))
    faces = list({f: (f, px, py) for f, px, py in reversed(faces) if np.linalg.norm(_unit_vectors(*_from_plane(np.array(px), np.array(py), np.array(f), res)) - v0) < 1e-7}.values())
    for f, px, py in faces:
        for a, b in zip(px + np.cos(_CORNERS) / math.sqrt(3), py + np.sin(_CORNERS) / math.sqrt(3)):
            lat, lon = _from_plane(a, b, np.array(f), res)
            if int(_nearest_face(lat, lon)) == f:
                points.append((float(lat), float(lon)))
    return _in_turn(*np.array(points).T, lat0, lon0)


#: Positions whose cells are found together.
POSITIONS = 1 << 18


def polyfill(wkb: bytes, res: int, mode: str = "overlap") -> list[int]:
    """Cells of a polygon, sorted: `overlap` those that share area with it, `full` those inside it, `center` those whose centre it covers."""
    return polyfills([wkb], res, mode)[0]


def polyfills(shapes: Sequence[bytes], res: int, mode: str = "overlap") -> list[list[int]]:
    """The cells of each polygon. Positions closer together than a cell's inner radius over the polygon's bounds name all cells that can qualify."""
    if mode not in ("overlap", "full", "center"):
        raise ValueError("mode must be overlap, full or center")
    rings = Rings(shapes)
    out: list[set[int]] = [set() for _ in shapes]
    for which, xs, ys in _positions(rings, res):
        found, at = np.unique(latlng_to_cell(ys, xs, res), return_inverse=True)
        which, at = np.divmod(np.unique(which * len(found) + at), len(found))
        if mode == "center":
            *_, lat, lon = _placed(found, res)
            good = rings.cover(which, np.degrees(lon)[at], np.degrees(lat)[at])
        else:
            made = cell_boundaries(found)
            windows = np.empty((len(found), max(map(len, made)), 2))
            for k, ring in enumerate(made):
                windows[k, : len(ring)], windows[k, len(ring) :] = ring, ring[-1]
            shared, _ = rings.window_areas(which, windows[at])
            good = shared > 0 if mode == "overlap" else shared >= np.abs(ring_areas(windows))[at] * (1 - 1e-9)
        for i, c in zip(which[good].tolist(), found[at[good]].tolist()):
            out[i].add(c)
    return [sorted(cells) for cells in out]


def _positions(rings: Rings, res: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shape, longitude, latitude) in blocks of about POSITIONS."""
    from terragrist.functions.cells import EDGE_KM

    step = math.degrees(EDGE_KM[res] / 6371.0) * 0.5
    rows: list[tuple[int, np.ndarray, float]] = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(x) for _, x, _ in rows]
        return np.repeat([i for i, _, _ in rows], n), np.concatenate([x for _, x, _ in rows]), np.repeat([y for _, _, y in rows], n)

    held = 0
    for i, box in enumerate(rings.bounds()):
        if box is None:
            continue
        x0, y0, x1, y1 = box[0] - 3 * step, max(-90.0, box[1] - 3 * step), box[2] + 3 * step, min(90.0, box[3] + 3 * step)
        for y in np.arange(y0, y1 + step, step).tolist():
            xs = np.arange(x0, x1 + step, step / max(0.05, math.cos(math.radians(min(89.0, abs(y))))))
            rows.append((i, xs, min(90.0, y)))
            held += len(xs)
            if held >= POSITIONS:
                yield block()
                rows, held = [], 0
    if rows:
        yield block()


def point_to_cell(res: int):
    """A function of longitude and latitude columns that gives cell ids, null for null coordinates."""

    @F.pandas_udf(T.LongType())
    def run(lon: pd.Series, lat: pd.Series) -> pd.Series:
        cells = latlng_to_cell(lat.to_numpy(float), lon.to_numpy(float), res)
        return pd.Series(cells, dtype="Int64").mask(cells == 0)

    return run


@F.pandas_udf(T.BinaryType())
def boundary_wkb(cell: pd.Series) -> pd.Series:
    """Boundary polygons of cells; null for null and 0, the grid's id of no cell. Beside nulls, pandas has ids as floats, which are not exact: give 0 for them."""
    out = np.full(len(cell), None, dtype=object)
    ok = np.flatnonzero((cell.notna() & (cell != 0)).to_numpy())
    if len(ok):
        found, at = np.unique(cell.iloc[ok].to_numpy(np.int64), return_inverse=True)
        made = np.empty(len(found), dtype=object)
        made[:] = [write_polygon([ring]) for ring in cell_boundaries(found)]
        out[ok] = made[at]
    return pd.Series(out)


def polygon_cells(res: int, mode: str = "overlap"):
    """A function of a WKB column that gives the array of its cells, to be exploded."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(wkb: pd.Series) -> pd.Series:
        ok = np.flatnonzero(wkb.notna().to_numpy())
        out = pd.Series([None] * len(wkb), dtype=object)
        for i, cells in zip(ok.tolist(), polyfills([bytes(g) for g in wkb.iloc[ok]], res, mode)):
            out.iat[i] = cells
        return out

    return run
