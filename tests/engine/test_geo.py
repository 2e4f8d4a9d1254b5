"""Geometry kernel, coverage, lookups, cells, rasters, vector sources, inventories and tiles."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrist.functions import cells, geometry
from terragrist.operators import coverage, lookup, tiles
from terragrist.sources import inventory, raster, vector

SQUARE = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0)]]


def _box(x0, y0, x1, y1):
    return geometry.write_polygon([[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]])


def test_codecs_round_trip():
    for wkt in ("POINT (1 2)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 2 0, 2 2, 0 0), (1 .5, 1.5 .5, 1.5 .7, 1 .5))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "MULTIPOINT (1 2, 3 4)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))"):
        wkb = geometry.from_wkt(wkt)
        assert geometry.from_geojson(json.loads(geometry.to_geojson(wkb))) == wkb
    big = struct.pack(">BI2d", 0, 1, 3.0, 4.0)
    assert geometry.to_geojson(big) == '{"type":"Point","coordinates":[3.0,4.0]}'
    assert geometry.to_geojson(geometry.from_wkt("POINT (1.123456789 2.987654321)"), 2) == '{"type":"Point","coordinates":[1.12,2.99]}'


def test_measures_and_predicates():
    p = geometry.polygons(geometry.write_polygon(SQUARE))
    assert geometry.area(p) == pytest.approx(3.75) and geometry.bounds(p) == (0, 0, 2, 2)
    assert geometry.centroid(p) == pytest.approx(((4 - 0.1875) / 3.75,) * 2)
    inside = {(0.2, 0.2): True, (0.75, 0.75): False, (0.5, 0.7): True, (2, 1): True, (0, 0): True, (2.1, 1): False}
    assert {k: geometry.covers(p, *k) for k in inside} == inside


def test_clip_area_against_sampling():
    rng = np.random.default_rng(4)
    hexagon = np.array([(math.cos(a), math.sin(a)) for a in np.arange(6) * math.pi / 3])
    for _ in range(10):
        angles = np.sort(rng.uniform(0, 2 * math.pi, 9))
        ring = np.stack([np.cos(angles), np.sin(angles)], axis=1) * rng.uniform(0.3, 1.6, 9)[:, None]
        g = np.stack(np.meshgrid(*[(np.arange(200) + 0.5) / 100 - 1] * 2), axis=-1).reshape(-1, 2)
        hit = sum(geometry.covers([[ring]], *q) and geometry.covers([[hexagon]], *q) for q in g[::7]) * 7 * 1e-4
        assert geometry.clip_area([[ring]], [[hexagon]]) == pytest.approx(hit, abs=0.06)


def test_coverage_of_squares(spark):
    polys = spark.createDataFrame([(1, "LUX", _box(0, 0, 2, 2)), (2, "BEL", _box(2, 0, 4, 2))], "poly_rid long, adm0_iso string, geom_wkb binary")
    hexes = spark.createDataFrame([("in", _box(0.5, 0.5, 1.5, 1.5)), ("edge", _box(-0.5, 0, 0.5, 1)), ("both", _box(1.5, 0, 2.5, 1))], "hex_id string, cell_wkb binary")
    cand = spark.createDataFrame([("in", 1), ("edge", 1), ("both", 1), ("both", 2)], "hex_id string, poly_rid long")
    got = sorted((r["hex_id"], r["adm0_iso"], round(r["pct"], 9)) for r in coverage.exploded_coverage(cand, polys, hexes, ["adm0_iso"]).collect())
    assert got == [("both", "BEL", 0.5), ("both", "LUX", 0.5), ("edge", "LUX", 0.5), ("in", "LUX", 1.0)]
    assert [r[0] for r in coverage.edge_hexes(cand, polys, hexes).collect()] == ["edge"]
    assert coverage.coverage_stats(coverage.exploded_coverage(cand, polys, hexes, ["adm0_iso"])).first()["coverage_rows"] == 4


def test_hierarchical_coverage_uses_parents(spark):
    child = lambda d: format((1 << 59) | (6 << 52) | (5 << 45) | (d << 27) | ((1 << 27) - 1), "x")
    parent = format((1 << 59) | (4 << 52) | (5 << 45) | ((1 << 33) - 1), "x")
    polys = spark.createDataFrame([(1, "LUX", _box(0, 0, 9, 9))], "poly_rid long, adm0_iso string, geom_wkb binary")
    ids = [child(d) for d in range(3)]
    hexes = spark.createDataFrame([(i, _box(20, 20, 21, 21)) for i in ids], "hex_id string, cell_wkb binary")
    parents = spark.createDataFrame([(parent, _box(1, 1, 4, 4))], "hex_id string, cell_wkb binary")
    cand = spark.createDataFrame([(i, 1) for i in ids], "hex_id string, poly_rid long")
    got = coverage.exploded_coverage(cand, polys, hexes, ["adm0_iso"], resolution=6, parents=parents)
    assert sorted((r["hex_id"], r["pct"]) for r in got.collect()) == [(i, 1.0) for i in sorted(ids)]


def test_lookup_contract_and_country_cells(spark):
    h1, h2 = "8828308281fffff", "8828308283fffff"
    rows = [(h1, "LUX", None, None, "9", None, 1.4), (h2, "LUX", "1", "n", "9", None, 0.6), (h2, "BEL", None, None, "3", None, 0.4), (h2, "DEU", None, None, "3", None, 0.0)]
    df = spark.createDataFrame(rows, "hex_id string, adm0_iso string, adm1_id string, adm1_name string, adm2_id string, adm2_name string, pct double")
    got = {r["hex_id"]: r for r in lookup.lookup_contract(df, 8).collect()}
    assert got[h1]["is_adm0_interior"] and got[h1]["best_pct"] == 1.0 and got[h1]["h3_r5"] == "85283083fffffff"
    assert got[h2]["best_adm0"] == "LUX" and got[h2]["adm0_count"] == 2 and [c["adm0_iso"] for c in got[h2]["coverage"]] == ["LUX", "BEL"]
    assert lookup.lookup_contract(df, 4).first()["h3_r5"] is None
    assert [r[0] for r in lookup.country_cells(lookup.lookup_contract(df, 8), "bel").collect()] == [h2]
    assert [r[0] for r in lookup.country_cells(df, "lux").collect()] == [h1, h2]
    assert lookup.lookup_contract(df.select("hex_id", "adm0_iso", "pct"), 8).count() == 2


def test_partitioned_lookup(spark, tmp_path):
    df = spark.createDataFrame([("8828308281fffff", 1), ("88754e6499fffff", 2)], "hex_id string, v int")
    lookup.write_partitioned(df, str(tmp_path / "p"), 8)
    assert sorted(p.name for p in (tmp_path / "p").glob("h3_r0=*")) == ["h3_r0=8029fffffffffff", "h3_r0=8075fffffffffff"]
    with pytest.raises(ValueError):
        lookup.write_partitioned(df, str(tmp_path / "q"), 8, 8)
    lookup.write_partitioned(df, str(tmp_path / "r8"), 8)
    rows = lookup.LookupCatalog(str(tmp_path)).assignments(spark, 8, 0, "8029fffffffffff")
    assert [r["v"] for r in rows.collect()] == [1] and "PartitionFilters: [isnotnull(h3_r0" in rows._jdf.queryExecution().executedPlan().toString()
    c = lookup.LookupCatalog("/x/")
    assert c.partitioned_uri(7, 0) == "/x/r7/h3_r0=*/*.parquet" and c.exploded_uri(7) == "/x/r7_exploded.parquet"


def test_max_overlap(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, None, 9.0), (2, None, 1.0)], "k int, v string, a double")
    assert sorted(tuple(r) for r in lookup.max_overlap(df, "k", "v", "a").collect()) == [(1, "a", 2.0), (2, None, None)]


def test_cell_bits_and_resolutions(spark):
    r = spark.createDataFrame([(0x8928308280FFFFF,)], "c long").select(cells.to_string(cells.parent(F.col("c"), 8)).alias("p"), cells.resolution(F.col("c")).alias("r"), cells.from_string(F.lit("zz")).alias("n")).first()
    assert tuple(r) == ("8828308281fffff", 9, None)
    assert cells.coverage_parent_resolution(5) is None and cells.coverage_parent_resolution(7) == 5
    assert cells.subsample_offsets(2) == [-0.25, 0.25] and cells.pixel_resolution(1e9) == 0
    assert cells.pixel_resolution(1000) > cells.pixel_resolution(10000)


def _zarr(path, packed):
    path.mkdir()
    data = np.arange(12, dtype="<f4").reshape(2, 2, 3)
    data[1, 1, 2] = np.nan
    (path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 2, 3], "chunks": [2, 2, 2], "dtype": "<f4", "order": "C", "fill_value": 7.0, "filters": None, "compressor": {"id": "zlib"} if packed else None}))
    (path / ".zattrs").write_text(json.dumps({"transform_mat3x3": [1, 0, 0, 0, -1, 2, 0, 0, 1], "dimensions": ["return period (years)"], "index_values": [10, 100]}))
    block = np.zeros((2, 2, 2), "<f4")
    block[:] = data[:, :, :2]
    (path / "0.0.0").write_bytes(zlib.compress(block.tobytes()) if packed else block.tobytes())
    if not packed:
        block[:] = 0
        block[:, :, :1] = data[:, :, 2:]
        (path / "0.0.1").write_bytes(block.tobytes())


@pytest.mark.parametrize("packed", [False, True])
def test_zarr(spark, tmp_path, packed):
    _zarr(tmp_path / "z", packed)
    z = raster.ZarrRaster.open(spark, str(tmp_path / "z"), raster.RasterMetadata("flood", "depth", "ssp585", 2050, "m"))
    rows = z.scan().collect()
    assert len(rows) == 12 and z.axis_name() == "return period (years)"
    if packed:
        assert sum(r["value"] == 7.0 and r["col"] == 2 for r in rows) == 4
        return
    assert sum(r["value"] or 0 for r in rows) == 55 and sum(r["value"] is None for r in rows) == 1
    at = spark.createDataFrame([(0.2, 1.8)], "longitude double, latitude double")
    got = sorted((r["axis_value"], r["value"], r["longitude"], r["latitude"]) for r in z.points(at).collect())
    assert got == [(10, 0.0, 0.5, 1.5), (100, 6.0, 0.5, 1.5)]
    assert z.scan((0, 0, 1, 1)).count() == 2 and len(z.curves().collect()) == 6 and z.knots().count() == 11
    with pytest.raises(ValueError, match="no pixel"):
        z.scan((50, 50, 51, 51))
    with pytest.raises(Exception, match="outside"):
        z.points(spark.createDataFrame([(9.0, 9.0)], "longitude double, latitude double")).collect()


def _tiff(path, packed):
    data = np.arange(16, dtype="<f4").reshape(4, 4) * 2 + 0.5
    data[1, 1] = -9999
    strips = [zlib.compress(data[i : i + 2].tobytes()) if packed else data[i : i + 2].tobytes() for i in (0, 2)]
    tags = [(256, 3, [4]), (257, 3, [4]), (258, 3, [32]), (259, 3, [8 if packed else 1]), (273, 4, None), (277, 3, [1]), (278, 3, [2]), (279, 4, [len(s) for s in strips]), (339, 3, [3]), (33550, 12, [0.01, 0.01, 0.0]), (33922, 12, [0, 0, 0, 0, 0.04, 0]), (42113, 2, b"-9999\0")]
    at, extra, body = 8 + 2 + 12 * len(tags) + 4, b"", b""
    heads = []
    where = at + 200
    offsets = [where, where + len(strips[0])]
    for tag, kind, v in tags:
        v = offsets if tag == 273 else v
        raw = v if kind == 2 else struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(v), *v)
        n = len(v)
        if len(raw) > 4:
            heads.append(struct.pack("<HHII", tag, kind, n, at + len(extra)))
            extra += raw
        else:
            heads.append(struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0"))
    body = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(heads) + struct.pack("<I", 0) + extra
    path.write_bytes(body.ljust(where, b"\0") + b"".join(strips))


@pytest.mark.parametrize("packed", [False, True])
def test_geotiff(spark, tmp_path, packed):
    _tiff(tmp_path / "t.tif", packed)
    rows = raster.scan_geotiff(spark, str(tmp_path / "t.tif")).collect()
    assert len(rows) == 15 and max(r["value"] for r in rows) == 30.5
    first = min(rows, key=lambda r: r["value"])
    assert (round(first["longitude"], 6), round(first["latitude"], 6)) == (0.005, 0.035)
    assert raster.scan_geotiff(spark, str(tmp_path / "t.tif"), (0.0, 0.0, 0.02, 0.02)).count() == 4


def test_reduce_and_tiles_of_an_area(spark):
    df = spark.createDataFrame([(5, 1.0), (1, 2.0), (5, 4.0), (3, 3.0), (1, 9.0), (7, float("nan")), (7, 1.0)], "cell long, value double")
    got = {r[0]: r[1] for r in raster.reduce_cells(df, "max").collect()}
    assert {k: v for k, v in got.items() if k != 7} == {1: 9.0, 3: 3.0, 5: 4.0} and math.isnan(got[7])
    assert {r[0]: r[1] for r in raster.reduce_cells(df.filter("cell < 7"), "min").collect()} == {1: 2.0, 3: 3.0, 5: 1.0}
    with pytest.raises(ValueError):
        raster.reduce_cells(df, "mean")
    assert raster.tile_bounds((0, 0, 2, 1), 1.0) == [(0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0)]
    p = spark.createDataFrame([(0.5, 0.5), (1.0, 0.5), (2.0, 1.0), (-9.0, 0.5), (None, 1.0)], "x double, y double")
    assert [r[0] for r in p.select(raster.owning_tile("x", "y", (0, 0, 2, 1), 1.0)).collect()] == [0, 1, 1, 0, None]


def test_vector_sources(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 1, "n": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    (tmp_path / "b.csv").write_text('id,geometry\n1,"POINT (1 2)"\n')
    (tmp_path / "c.csv").write_text(f"id,geometry\n1,{geometry.from_wkt('POINT (1 2)').hex()}\n")
    want = geometry.from_wkt("POINT (1 2)")
    for name, fmt in (("a.geojson", "geojson"), ("b.csv", "wkt"), ("c.csv", "wkb")):
        r = vector.read_vector(spark, str(tmp_path / name), fmt, keep_source="raw").first()
        assert bytes(r["geom_wkb"]) == want and r["id"] == "1" and r["raw"] is not None
    spark.createDataFrame([(1, want), (2, None)], "id int, geometry binary").write.parquet(str(tmp_path / "d"))
    assert vector.read_vector(spark, str(tmp_path / "d"), "geoparquet").count() == 2
    assert vector.measure(spark, str(tmp_path / "d"), "geometry")[1] == 1
    with pytest.raises(FileNotFoundError):
        vector.measure(spark, str(tmp_path / "none*"))
    multi = spark.createDataFrame([(1, geometry.from_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"))], "id int, geom_wkb binary")
    assert vector.explode_parts(multi).count() == 2


def test_inventory():
    inv = inventory.Inventory.from_dict({"resources": [{"hazard_type": "flood", "indicator_id": "d", "path": "p/{scenario}/{year}/{gcm}", "params": {"gcm": ["a"]}, "scenarios": [{"id": "rcp", "years": [2030]}], "units": "m"}, {"hazard_type": "wind", "indicator_id": "d", "path": "w/{model}"}]})
    r = inv.select(hazard_type="flood")
    assert r.resolve("rcp", 2030, gcm="a") == "p/rcp/2030/a"
    for bad in (("x", 2030, {"gcm": "a"}), ("rcp", 2031, {"gcm": "a"}), ("rcp", 2030, {}), ("rcp", 2030, {"gcm": "b"})):
        with pytest.raises(ValueError):
            r.resolve(*bad[:2], **bad[2])
    with pytest.raises(LookupError):
        inv.select(indicator_id="d")


def test_features_and_tiler(spark):
    rows = spark.createDataFrame([(1, "a", None, geometry.from_wkt("POINT (1.23456789 2)")), (2, "b", "n", None)], "id long, keep string, drop string, geometry binary")
    layer = tiles.Layer("l", rows, tiles.ZoomRange.of([0, 5]), ("id", "keep", "absent"))
    (r,) = tiles.features([layer], precision=2).collect()
    assert r[0] == '\x1e{"type":"Feature","tippecanoe":{"layer":"l","minzoom":0,"maxzoom":5},"geometry":{"type":"Point","coordinates":[1.23,2.0]},"properties":{"id":1,"keep":"a"}}\n'
    assert tiles.ZoomRange.of([3, 1, 7]) == tiles.ZoomRange(1, 7) and "-Z0" in tiles.tiler_command("points", "o", tiles.ZoomRange(0, 5))
    with pytest.raises(ValueError):
        tiles.ZoomRange(5, 4)
    with pytest.raises(ValueError, match="300.0 GiB"):
        tiles.check_budget(10 << 30, 100 << 30)
    with pytest.raises(FileNotFoundError):
        tiles.run_tiler([layer], "points", "o", binary="no-such-tiler")
