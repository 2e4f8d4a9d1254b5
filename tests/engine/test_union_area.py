"""Unions and repair against sampling and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrist.functions import geometry
from terragrist.functions.repair import repair_polygon, repair_wkb, repaired
from terragrist.operators import union_area
from terragrist.operators.indexing import resolution_estimates
from terragrist.operators.union_area import covered, union_areas


def _inside(rings, x, y):
    """Even-odd, for many points."""
    odd = np.zeros(len(x), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, axis=0)):
            span = (ay > y) != (by > y)
            if ay != by:
                odd ^= span & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return odd


def _random_polygons(n, seed, corners=7):
    rng = np.random.default_rng(seed)
    return [[rng.uniform(0, 2, 2) + rng.uniform(-1, 1, (corners, 2))] for _ in range(n)]


def _table(spark, polys, **columns):
    rows = [(k, geometry.write_polygon(p)) for k, p in enumerate(polys)]
    return spark.createDataFrame(rows, "id int, geom_wkb binary").select("*", *[c.alias(n) for n, c in columns.items()])


def _square(x, y, size=1.0):
    return np.array([[x, y], [x + size, y], [x + size, y + size], [x, y + size]], float)


def test_lengths_of_slabs_are_as_sampled():
    a, b = _random_polygons(6, 1), _random_polygons(5, 2)
    got = covered([(False, p) for p in a] + [(True, p) for p in b])
    rng = np.random.default_rng(3)
    x, y = rng.uniform(-2, 4, (2, 200_000))
    in_a, in_b = (np.any([_inside(p, x, y) for p in s], axis=0) for s in (a, b))
    for value, seen in zip(got, (in_a, in_b, in_a & in_b)):
        assert value == pytest.approx(seen.mean() * 36, abs=0.1)


def test_squares_cut_again_change_nothing(spark, monkeypatch):
    """Self-crossing polygons that overlap, measured as a whole and in many squares; the finest differ by nothing but rounding."""
    a, b = _random_polygons(30, 4), _random_polygons(20, 5)
    want = covered([(False, p) for p in a] + [(True, p) for p in b])
    for edges in (192, 12):
        monkeypatch.setattr(union_area, "EDGES", edges)
        monkeypatch.setattr(union_area, "DEPTH", 24 if edges > 20 else 5)
        got = union_areas(_table(spark, a), _table(spark, b)).first()
        assert tuple(got) == pytest.approx(want, rel=1e-9 if edges > 20 else 0.05)


def test_shared_borders_holes_copies_and_multipolygons(spark):
    lattice = [[_square(x, y)] for x in range(20) for y in range(20)]
    ring = [[_square(0, 0, 30.0), _square(5, 5, 10.0)]]
    got = union_areas(_table(spark, lattice * 3), _table(spark, ring)).first()
    assert tuple(got) == pytest.approx((400.0, 800.0, 300.0), abs=1e-9)
    two = geometry.write_wkb("MultiPolygon", [[_square(0, 0, 2.0)], [_square(1, 1, 2.0)]])
    both = spark.createDataFrame([("a", two), ("a", two), (None, geometry.write_polygon([_square(-3, -3)])), ("gone", None)], "k string, geom_wkb binary")
    assert {r["k"]: r["first"] for r in union_areas(both, by=["k"]).collect()} == pytest.approx({"a": 7.0, None: 1.0})


def test_no_area_no_row(spark):
    flat = geometry.write_polygon([np.array([[0, 0], [1, 1], [2, 2.0]])])
    df = spark.createDataFrame([(flat,), (None,)], "geom_wkb binary")
    assert union_areas(df).collect() == [] and union_areas(df.limit(0)).collect() == []


def test_many_edges_through_one_point_end(spark, monkeypatch):
    monkeypatch.setattr(union_area, "EDGES", 8)
    monkeypatch.setattr(union_area, "DEPTH", 8)
    turn = np.linspace(0, 2 * np.pi, 25)
    star = [[np.array([[0.1, 0.1], [0.1 + np.cos(a), 0.1 + np.sin(a)], [0.1 + np.cos(b), 0.1 + np.sin(b)]])] for a, b in zip(turn, turn[1:])]
    assert union_areas(_table(spark, star)).first()["first"] == pytest.approx(12 * np.sin(2 * np.pi / 24), rel=1e-3)


def test_bow_tie_and_pentagram():
    bow = [np.array([[0, 0], [2, 2], [2, 0], [0, 2.0]])]
    parts = repair_polygon(bow)
    assert sorted(len(p[0]) for p in parts) == [3, 3] and geometry.area(parts) == pytest.approx(2.0)
    turn = np.pi / 2 + np.arange(5) * 4 * np.pi / 5
    points = repair_polygon([np.stack([np.cos(turn), np.sin(turn)], axis=1)])
    x, y = np.random.default_rng(0).uniform(-1, 1, (2, 100_000))
    assert len(points) == 5 and geometry.area(points) == pytest.approx(_inside([np.stack([np.cos(turn), np.sin(turn)], axis=1)], x, y).mean() * 4, abs=0.03)


def test_valid_polygons_pass_and_repairs_hold():
    ring = geometry.write_polygon([_square(0, 0, 3.0), _square(1, 1)])
    assert repair_wkb(ring) == ring
    # a hole that touches its outline along a side becomes a bay
    bay = repair_polygon([_square(0, 0, 3.0), np.array([[0, 1], [1, 1], [1, 2], [0, 2.0]])])
    assert len(bay) == 1 and len(bay[0]) == 1 and geometry.area(bay) == pytest.approx(8.0)
    # a ring that runs twice encloses nothing; a line there and back is no area
    assert repair_polygon([np.concatenate([_square(0, 0), _square(0, 0)])]) == []
    for seed in range(40):
        (rings,) = _random_polygons(1, seed, corners=9)
        parts = repair_polygon(rings) or [rings]
        assert geometry.area(parts) == pytest.approx(covered([(False, rings)])[0], rel=1e-9)
        assert all(repair_polygon(p) is None for p in parts if len(p) == 1 and len(np.unique(p[0], axis=0)) == len(p[0]))
        assert all(geometry.ring_area(p[0]) > 0 and all(geometry.ring_area(h) < 0 for h in p[1:]) for p in parts)


def test_repaired_column(spark):
    bow = geometry.write_polygon([np.array([[0, 0], [2, 2], [2, 0], [0, 2.0]])])
    df = spark.createDataFrame([(bow,), (None,), (geometry.write_wkb("Point", [np.array([[1.0, 2.0]])]),)], "g binary").withColumn("m", repaired("g"))
    got = df.collect()
    assert got[1]["m"] is None and got[2]["m"] == got[2]["g"]
    assert df.select(geometry.polygon_area("m").alias("a")).filter(F.col("a") > 0).first()["a"] == pytest.approx(2.0)


def test_resolutions_do_not_count_overlaps_twice(spark):
    shapes = _table(spark, [[_square(10, 10, 3.0)], [_square(11, 10, 3.0)]])
    one, two = resolution_estimates(shapes.limit(1).unionByName(shapes.limit(1)), [3]).first(), resolution_estimates(shapes.limit(1), [3]).first()
    assert one["cell_count"] == 2 * two["cell_count"] and one["error"] == pytest.approx(two["error"])
    joined = resolution_estimates(_table(spark, [[np.array([[10, 10], [14, 10], [14, 13], [10, 13.0]])]]), [3, 4]).orderBy("resolution").collect()
    apart = resolution_estimates(shapes, [3, 4]).orderBy("resolution").collect()
    assert [r["error"] for r in apart] == pytest.approx([r["error"] for r in joined], rel=1e-6)
