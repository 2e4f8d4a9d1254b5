"""Cells and areas of many polygons at once against one at a time."""

import time

import numpy as np

from terragrist.functions import geometry as g
from terragrist.functions import hexgrid as h
from terragrist.plans import queries as q


def _shapes(n: int) -> list[bytes]:
    rng, out = np.random.default_rng(3), []
    for k in range(n):
        x, y, turn = rng.uniform(-170, 170), rng.uniform(-70, 70), np.linspace(0, 2 * np.pi, 3 + k % 9, endpoint=False)
        ring = np.stack([x + rng.uniform(0.3, 2, len(turn)) * np.cos(turn), y + rng.uniform(0.3, 2, len(turn)) * np.sin(turn)], axis=1)
        hole = np.array([[x - 0.05, y - 0.05], [x + 0.05, y - 0.05], [x + 0.05, y + 0.05], [x - 0.05, y + 0.05]])
        out.append(g.write_wkb("MultiPolygon", [[ring], [ring + 5]]) if k % 3 else g.write_polygon([ring, hole]))
    return out


def test_cells_of_many_polygons_equal_those_of_each():
    shapes = _shapes(20)
    empty = g.write_wkb("MultiPolygon", [])
    assert h.polyfills([empty, *shapes], 3) == [[], *(h.polyfill(s, 3) for s in shapes)]
    for s, cells in zip(shapes, h.polyfills(shapes, 3)):
        polys = g.polygons(s)
        areas = {c: g.clip_area(polys, [[h.cell_boundary(c)]]) for c in cells}
        assert cells and min(areas.values()) > 0 and sum(areas.values()) > g.area(polys) * (1 - 1e-9)


def test_areas_and_covers_equal_those_of_pairs():
    shapes = _shapes(30)
    polys, rng = [g.polygons(s) for s in shapes], np.random.default_rng(4)
    own = np.repeat(np.arange(len(shapes)), 30)
    low = np.array([p[0][0].min(axis=0) for p in polys])[own] + rng.uniform(-0.5, 3, (len(own), 2))
    size = rng.choice([0.01, 0.4, 2], len(own))[:, None]
    windows = np.stack([low, low + size * [1, 0], low + size, low + size * [0, 1]], axis=1)
    rings = g.Rings(shapes)
    areas, _ = rings.window_areas(own, windows)
    assert np.allclose(areas, [g.clip_area(polys[i], [[w]]) for i, w in zip(own, windows)], atol=1e-12) and (areas > 0).any()
    covered = rings.cover(own, *low.T)
    assert covered.tolist() == [g.covers(polys[i], *p) for i, p in zip(own, low)] and covered.any()


def test_a_thousand_rectangles_take_no_seconds_each():
    x, y = np.meshgrid(np.arange(-60, 60, 4.0), np.arange(-60, 60, 3.5))
    boxes = [g.write_polygon([np.array([[a, b], [a + 1.5, b], [a + 1.5, b + 1.5], [a, b + 1.5]])]) for a, b in zip(x.ravel(), y.ravel())]
    begun = time.process_time()
    assert len(boxes) > 1000 and min(map(len, h.polyfills(boxes, 4))) > 10
    assert time.process_time() - begun < 40  # 0.15 seconds a rectangle one cell after another


def test_polygons_of_one_file_are_many_tasks(spark):
    plan = q.polyfill(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
