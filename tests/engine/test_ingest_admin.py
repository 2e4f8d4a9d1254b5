"""Raster ingest, district enrichment, shapefiles, overlay areas and projections."""

import json
import struct

import numpy as np
import pytest

from terragrist.functions import fitting, geometry
from terragrist.operators import admin, ingest
from terragrist.schema import validate
from terragrist.sources import raster, vector


def _square(x, y, s=1.0):
    return [[np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], dtype=float)]]


def test_intersection_area():
    assert geometry.intersection_area(_square(0, 0), _square(0.5, 0.25)) == pytest.approx(0.375)
    assert geometry.intersection_area(_square(0, 0), _square(5, 5)) == 0
    rng = np.random.default_rng(3)
    star = lambda: [[np.stack([np.cos(t), np.sin(t)], axis=1) * rng.uniform(0.3, 1.5, 12)[:, None]]] if (t := np.sort(rng.uniform(0, 6.28, 12))) is not None else None
    for _ in range(5):
        a, b = star(), star()
        g = (np.stack(np.meshgrid(np.arange(80), np.arange(80)), axis=-1).reshape(-1, 2) + 0.5) / 80 * 3.2 - 1.6
        hit = sum(geometry.covers(a, *q) and geometry.covers(b, *q) for q in g) * (3.2 / 80) ** 2
        assert geometry.intersection_area(a, b) == pytest.approx(hit, abs=0.05)
        assert geometry.intersection_area(a, a) == pytest.approx(geometry.area(a))


def test_projections():
    assert geometry.to_degrees(np.array([[500000.0, 4649776.22482]]), 32633) == pytest.approx(np.array([[15.0, 42.0]]), abs=1e-6)
    assert geometry.to_degrees(np.array([[1113194.9079, 5160979.4443]]), 3857) == pytest.approx(np.array([[10.0, 42.0]]), abs=1e-5)
    with pytest.raises(ValueError):
        geometry.to_degrees(np.zeros((1, 2)), 27572)
    assert geometry.to_geojson(geometry.reproject(geometry.from_wkt("POINT (500000 4649776.22482)"), 32633), 4) == '{"type":"Point","coordinates":[15.0,42.0]}'


def test_districts(spark):
    w = lambda p: geometry.write_polygon(p[0])
    adm1 = spark.createDataFrame([("1", "west", "LUX", w(_square(0, 0, 2))), ("2", "east", "LUX", w(_square(2, 0, 2))), ("3", "other", "BEL", w(_square(0, 0, 4)))], "adm1_id string, adm1_name string, adm0_iso string, geom_wkb binary")
    adm2 = spark.createDataFrame([(1, "LUX", w(_square(1.75, 0))), (2, "LUX", w(_square(0.2, 0.2, 0.5))), (3, "DEU", w(_square(0, 0)))], "adm2_rid long, adm0_iso string, geom_wkb binary")
    got = {r["adm2_rid"]: (r["adm1_id"], r["adm1_name"]) for r in admin.enrich_districts(adm2, adm1).collect()}
    assert got == {1: ("2", "east"), 2: ("1", "west"), 3: (None, None)}


def test_canonical_rows_of_a_raster(spark, tmp_path):
    p = tmp_path / "z"
    p.mkdir()
    rp = np.array([2.0, 5, 10, 100, 1000])
    z = -np.log(-np.log(1 - 1 / rp))
    data = np.stack([np.stack([1 + 2 * z, np.full(5, 3.0)], axis=1)], axis=1).astype("<f8")  # one fits, one is constant
    (p / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 1, 2], "chunks": [5, 1, 2], "dtype": "<f8", "order": "C", "fill_value": None, "filters": None, "compressor": None}))
    (p / ".zattrs").write_text(json.dumps({"transform_mat3x3": [0.1, 0, 6.0, 0, -0.1, 50.0], "dimensions": ["return period"], "index_values": rp.tolist()}))
    (p / "0.0.0").write_bytes(np.ascontiguousarray(data).tobytes())
    r = raster.ZarrRaster.open(spark, str(p), raster.RasterMetadata("flood", "depth", "ssp585", 2050, "m"))
    policy = ingest.IngestPolicy(7, "flood", "tests", "1", fitting.FitPolicy(on_failure="skip"))
    rows = validate(ingest.canonicalize(r, policy))
    got = rows.collect()
    assert len(got) > 3 and {x["source_id"] for x in got} == {got[0]["source_id"]} and len(got[0]["source_id"]) == 64
    assert got[0]["curve_location"] == pytest.approx(1) and got[0]["curve_scale"] == pytest.approx(2) and policy.metadata(r).unit == "m"
    assert {x["tile"] for x in ingest.with_tiles(rows, (6.0, 49.8, 6.2, 50.0), 0.1).collect()} == {2}
    with pytest.raises(Exception, match="curve fit failed"):
        ingest.canonicalize(r, ingest.IngestPolicy(7, "flood", "tests", "1")).collect()
    with pytest.raises(ValueError):
        ingest.IngestPolicy(16, "flood", "t", "1")


def test_shapefile(spark, tmp_path):
    ring = np.array([(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)], dtype="<f8")
    hole = np.array([(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5)], dtype="<f8")
    body = struct.pack("<i4d2i2i", 5, 0, 0, 2, 2, 2, 9, 0, 5) + ring.tobytes() + hole.tobytes()
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(struct.pack("<B3BIHH", 3, 0, 0, 0, 1, 65, 6).ljust(32, b"\0") + field + b"\r" + b" " + b"lux  ")
    r = vector.read_vector(spark, str(tmp_path / "a.shp"), "shapefile").first()
    assert r["name"] == "lux" and geometry.area(geometry.polygons(bytes(r["geom_wkb"]))) == pytest.approx(4 - 0.125)
