"""Grid positions against published cells, and the grid's own invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrist.functions import cells, geometry, hexgrid
from terragrist.operators import indexing

KNOWN = [
    (37.3615593, -122.0553238, 5, "85283473fffffff"),
    (37.7752702151959, -122.418307270836, 9, "8928308280fffff"),
    (37.769377, -122.388903, 9, "89283082e73ffff"),
    (20.0, 123.0, 2, "824b9ffffffffff"),
    (48.8566, 2.3522, 7, "871fb4662ffffff"),
    (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
    (0.0, 0.0, 5, "85754e67fffffff"),
]


def _sphere(n):
    u = np.random.default_rng(8).normal(size=(n, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u, np.degrees(np.arcsin(u[:, 2])), np.degrees(np.arctan2(u[:, 1], u[:, 0]))


@pytest.mark.parametrize("lat,lon,res,want", KNOWN)
def test_published_cells(lat, lon, res, want):
    assert format(int(hexgrid.latlng_to_cell(np.array([lat]), np.array([lon]), res)[0]), "x") == want


def test_every_cell_exists_and_is_compact():
    u, lat, lon = _sphere(60000)
    for res, radius in ((0, 0.25), (1, 0.1), (2, 0.04)):
        c = hexgrid.latlng_to_cell(lat, lon, res)
        found, at = np.unique(c, return_inverse=True)
        if res < 2:
            assert len(found) == 2 + 120 * 7**res
        mean = np.stack([np.bincount(at, u[:, i]) for i in range(3)], axis=1)
        mean /= np.linalg.norm(mean, axis=1)[:, None]
        assert np.linalg.norm(u - mean[at], axis=1).max() < radius


def test_centres_lead_back_and_boundaries_hold_their_points():
    _, lat, lon = _sphere(150)
    for res in (2, 6, 10):
        for c, y, x in zip(hexgrid.latlng_to_cell(lat, lon, res), lat, lon):
            a, b = hexgrid.cell_center(c)
            assert hexgrid.latlng_to_cell(np.array([a]), np.array([b]), res)[0] == c
            ring = hexgrid.cell_boundary(c)
            if abs(y) < 55:
                assert geometry.covers([[ring]], ring[:, 0].mean() + (x - ring[:, 0].mean() + 180) % 360 - 180, y)


def test_published_boundary():
    want = [(-122.09043, 37.33756), (-122.0291, 37.2632), (-121.91508, 37.27136), (-121.86222, 37.35393), (-121.92355, 37.42834), (-122.03773, 37.42013)]
    assert hexgrid.cell_boundary(0x85283473FFFFFFF).round(5).tolist() == [list(p) for p in want]


def test_nulls_and_columns(spark):
    df = spark.createDataFrame([(2.3522, 48.8566), (None, 1.0)], "x double, y double")
    r = df.select(cells.to_string(hexgrid.point_to_cell(7)(F.col("x"), F.col("y")))).collect()
    assert [x[0] for x in r] == ["871fb4662ffffff", None]


def test_index_modes(spark):
    w = geometry.write_polygon([[(-0.25, 51.25), (0.25, 51.25), (0.25, 51.75), (-0.25, 51.75)]])
    df = spark.createDataFrame([(1, w)], "id int, geom_wkb binary")
    overlap = indexing.index_polygons(df, 5, "overlap")
    inside = indexing.index_polygons(df, 5, "contains")
    exact = indexing.index_polygons(df, 5, "exact_intersection").collect()
    assert overlap.columns == ["id", "cell"] and inside.count() < overlap.count() == len(exact)
    assert sum(r["intersection_ratio"] for r in exact) == pytest.approx(1.0, abs=1e-6)
    assert indexing.index_polygons(df, 5, "centroid", as_string=True).first()["cell"].startswith("85")
    with pytest.raises(ValueError):
        indexing.index_polygons(df, 5, "nope")
    assert indexing.resolution_estimates(df, [4, 6]).orderBy("resolution").collect()[1]["error"] < 1


def test_pixels_fill_cells(spark):
    rows = [(x / 10 + 0.05, y / 10 + 0.05, float(x)) for x in range(10) for y in range(10)]
    got = indexing.pixels_to_cells(spark.createDataFrame(rows, "longitude double, latitude double, value double"), 0.1, 0.1).collect()
    assert len({r["cell"] for r in got}) == len(got) > 20
