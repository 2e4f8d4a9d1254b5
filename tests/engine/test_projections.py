"""Inverse projections against the worked examples of the registry's guidance notes."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terragrist.functions import geometry
from terragrist.functions.projections import Projection, lonlat, projection_of
from terragrist.operators.tiles import Layer, ZoomRange, geometry_and_crs, layer_features


def _dms(d, m=0, s=0.0):
    return d + m / 60 + s / 3600


#: (projection, easting, northing, longitude, latitude)
EXAMPLES = {
    "two parallels, in feet": (Projection("lambert conic conformal", _dms(27, 50), -99, _dms(28, 23), _dms(30, 17), 1, 2000000, 0, 20925832.16, 294.97870), 2963503.91, 254759.80, -96.0, 28.5),
    "one parallel": (Projection("lambert conic conformal", 18, -77, None, None, 1, 250000, 150000, 6378206.4, 294.97870), 255966.58, 142493.51, -_dms(76, 56, 37.26), _dms(17, 55, 55.80)),
    "transverse": (Projection("transverse mercator", 49, -2, None, None, 0.9996012717, 400000, -100000, 6377563.396, 299.32496), 577274.99, 69740.50, 0.5, 50.5),
    "mercator": (Projection("mercator", 0, 110, None, None, 0.997, 3900000, 900000, 6377397.155, 299.15281), 5009726.58, 569150.82, 120.0, -3.0),
    "mercator by its parallel": (Projection("mercator", 0, 51, 42, None, 1, 0, 0, 6378245.0, 298.3), 165704.29, 5171848.07, 53.0, 53.0),
    "web": (projection_of(3857), -11169055.58, 2800000.00, -_dms(100, 20), _dms(24, 22, 54.433)),
    "pole by its scale": (projection_of("EPSG:32661"), 3320416.75, 632668.43, 44.0, 73.0),
    "pole by its parallel": (projection_of("urn:ogc:def:crs:EPSG::3032"), 7255380.79, 7053389.56, 120.0, -75.0),
    "azimuthal": (projection_of("epsg:3035"), 3962799.45, 2999718.85, 5.0, 50.0),
}


@pytest.mark.parametrize("name", EXAMPLES)
def test_published_coordinates(name):
    p, x, y, lon, lat = EXAMPLES[name]
    assert p.points(np.array([[x, y]]))[0] == pytest.approx([lon, lat], abs=3e-7)


def test_columns_are_the_same_in_generated_code(spark):
    for p, x, y, lon, lat in EXAMPLES.values():
        df = spark.createDataFrame([(x, y), (None, y)], "x double, y double")
        a, b = p.lonlat(F.col("x"), F.col("y"))
        out = df.select(a.alias("lon"), b.alias("lat"))
        rows = out.collect()
        assert tuple(rows[0]) == pytest.approx(p.points(np.array([[x, y]]))[0], abs=1e-11)
        assert rows[1]["lon"] is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_origins_and_round_figures():
    """The false origin of each system lies at its stated place."""
    for code, lon, lat in ((3035, 10, 52), (3034, 10, 52), (2154, 3, 46.5), (5070, -96, 23), (32633, 15, 0), (25832, 9, 0), (26918, -75, 0)):
        p = projection_of(code)
        assert p.points(np.array([[p.east, p.north]]))[0] == pytest.approx([lon, lat], abs=1e-10)
    for code, lat in ((3031, -90), (3413, 90), (3995, 90), (32761, -90)):
        p = projection_of(code)
        assert p.points(np.array([[p.east, p.north]]))[0, 1] == pytest.approx(lat, abs=1e-9)


def test_equal_areas_are_equal():
    """A kilometre square has the same area on the ellipsoid wherever it lies in an equal-area system."""
    for code, places in ((3035, [(4321000, 3210000), (2800000, 1900000), (6200000, 4700000)]), (5070, [(0, 0), (-2000000, 2500000), (2100000, 1000000)])):
        p = projection_of(code)
        for x, y in places:
            lon, lat = np.radians(p.points(np.array([[x, y], [x + 1000, y], [x + 1000, y + 1000], [x, y + 1000.0]]))).T
            q = np.array([p._q(v) for v in lat])  # authalic, so that a strip's area is its width times the difference of q
            assert abs(geometry.ring_area(np.stack([lon, q], axis=1))) * p.axis**2 / 2 == pytest.approx(1e6, rel=1e-6)


def _described(method, parameters, unit="metre"):
    degree = {"type": "AngularUnit", "name": "degree", "conversion_factor": 0.017453292519943295}
    listed = [{"name": n, "value": v, "unit": degree if "itude" in n else unit} for n, v in parameters.items()]
    base = {"type": "GeographicCRS", "datum": {"ellipsoid": {"semi_major_axis": 6378137, "inverse_flattening": 298.257222101}}}
    return {"type": "ProjectedCRS", "name": "own", "base_crs": base, "conversion": {"method": {"name": method}, "parameters": listed}, "coordinate_system": {"axis": [{"unit": unit}, {"unit": unit}]}}


def test_described_systems():
    said = _described("Lambert Azimuthal Equal Area", {"Latitude of natural origin": 52, "Longitude of natural origin": 10, "False easting": 4321000, "False northing": 3210000})
    own, known = projection_of(said), projection_of(3035)
    xy = np.array([[3962799.45, 2999718.85]])
    assert own.points(xy) == pytest.approx(known.points(xy), abs=1e-12)
    foot = {"type": "LinearUnit", "name": "foot", "conversion_factor": 0.3048}
    feet = _described("Lambert Azimuthal Equal Area", {"Latitude of natural origin": 52, "Longitude of natural origin": 10, "False easting": 4321000 / 0.3048, "False northing": 3210000 / 0.3048}, foot)
    assert projection_of(feet).points(xy / 0.3048) == pytest.approx(known.points(xy), abs=1e-10)
    assert projection_of(json.dumps(said | {"id": {"authority": "EPSG", "code": 3035}})) == known
    assert projection_of({"type": "GeographicCRS", "name": "any"}) is None
    assert [projection_of(c) for c in (None, "", "OGC:CRS84", "epsg:4326", 4326, {"id": {"authority": "OGC", "code": "CRS84"}})] == [None] * 6


@pytest.mark.parametrize("crs", ["EPSG:99999", "somewhere", 27572, {"type": "EngineeringCRS"}, {"id": {"authority": "EPSG", "code": 99999}}, _described("Oblique Mercator", {})])
def test_unknown_systems_raise(crs):
    with pytest.raises(ValueError):
        projection_of(crs)


def test_layers_of_files_say_their_system(spark, tmp_path):
    wkb = geometry.write_wkb("Point", [np.array([[3962799.45, 2999718.85]])])
    said = {"primary_column": "shape", "columns": {"shape": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 3035}}}}}
    table = pa.table({"n": [1, 2], "geometry": ["not this", "one"], "shape": pa.array([wkb, None], pa.binary())}).replace_schema_metadata({"geo": json.dumps(said)})
    pq.write_table(table, tmp_path / "x.parquet")
    layer = Layer.from_parquet(spark, str(tmp_path), "sites", ZoomRange(0, 5), ("n",))
    (row,) = layer_features(layer, 5).collect()
    assert json.loads(row["feature"].strip("\x1e\n"))["geometry"] == {"type": "Point", "coordinates": [5.0, 50.0]}
    assert geometry_and_crs({"primary_column": "gone"}, ["a", "GEOM"]) == ("GEOM", None)
    with pytest.raises(ValueError):
        layer_features(Layer("x", layer.rows, ZoomRange(0, 5), ("n",), "shape", "EPSG:1"))
    x, y = lonlat("x", "y", None)
    assert spark.createDataFrame([(1.0, 2.0)], "x double, y double").select(x, y).first() == (1.0, 2.0)
