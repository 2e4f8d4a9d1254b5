"""Writers, overlays and scans added around the stores: whole-or-nothing writes, plans with one geometry pass, bounded overlay."""

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terragrist.functions import geometry
from terragrist.operators import admin, coverage, indexing, ingest, lookup
from terragrist.plans import surrogates
from terragrist.schema import COLUMNS, HazardMetadata
from terragrist.sources.hazard import read_hazard, write_hazard_batches
from terragrist.sources.publish import publish, work_folder
from terragrist.sources.vector import geo_metadata


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_publish_is_whole_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(10)
    assert publish(df, path).count() == 10
    with pytest.raises(FileExistsError):
        publish(df, path)
    broken = df.select(F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        publish(broken, path, mode="overwrite")
    assert spark.read.parquet(path).count() == 10 and os.listdir(tmp_path) == ["out"]
    assert publish(df.limit(3), path, mode="overwrite").count() == 3
    with pytest.raises(ValueError):
        publish(df, path, mode="append")


def test_no_batches_give_a_typed_table(spark, tmp_path):
    path = str(tmp_path / "empty")
    write_hazard_batches(spark, [], path, HazardMetadata(7, "m", "depth", "t", "1"))
    found = read_hazard(spark, path)
    assert found.columns == COLUMNS and found.count() == 0


def _star(n, seed, x=0.0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(0.5, 1.0, n)
    return [[np.stack([x + r * np.cos(t), r * np.sin(t)], axis=1)]]


def test_overlay_in_parts_equals_the_whole(monkeypatch):
    a, b = _star(300, 1), _star(400, 2, 0.3)
    whole = geometry.intersection_area(a, b)
    monkeypatch.setattr(geometry, "EDGE_PAIRS", 500)
    assert abs(geometry.intersection_area(a, b) - whole) < 1e-9 and 0.5 < whole < 3


def test_large_outlines_stay_in_memory():
    t = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    outline = lambda x: [[np.stack([x + np.cos(t), np.sin(t)], axis=1)]]
    assert abs(geometry.intersection_area(outline(0.0), outline(0.5)) - (2 * np.arccos(0.25) - 0.25 * np.sqrt(3.75))) < 1e-4


def test_share_of_a_cell_equals_clipping():
    rng = np.random.default_rng(5)
    polys = _star(60, 6)
    edges = geometry._all_edges(polys)
    hexagon = np.stack([np.cos(np.arange(6) * np.pi / 3), np.sin(np.arange(6) * np.pi / 3)], axis=1) * 0.08
    for _ in range(300):
        cell = [[hexagon + rng.uniform(-1.2, 1.2, 2)]]
        want = geometry.clip_area(polys, cell) / geometry.area(cell)
        assert abs(geometry.share_of_cell(polys, edges, cell) - want) < 1e-9


def test_geometry_is_computed_once(spark):
    box = geometry.box_wkb(*[F.col("id") * 0.5 + x for x in (0.0, 0.0, 1.0, 1.0)])
    polys = spark.range(6).select(F.col("id").alias("poly_rid"), F.lit("A").alias("adm0_iso"), box.alias("geom_wkb"))
    cells = spark.range(4).select(F.col("id").cast("string").alias("hex_id"), box.alias("cell_wkb"))
    pairs = cells.crossJoin(polys).select("hex_id", "poly_rid")
    assert _plan(coverage.shares(pairs, polys, cells)).count("_cell_share(") == 1
    one = polys.select(F.col("poly_rid").cast("string").alias("adm1_id"), F.lit("n").alias("adm1_name"), "adm0_iso", "geom_wkb")
    out = admin.enrich_districts(polys.withColumnRenamed("poly_rid", "adm2_rid"), one)
    assert _plan(out).count("_shared_area(") == 1
    assert {r["adm2_rid"]: r["adm1_id"] for r in out.collect()} == {i: str(i) for i in range(6)}


def test_ties_take_id_and_name_of_one_district(spark):
    box = geometry.box_wkb(*[F.col(c) for c in ("x", "y", "u", "v")])
    rows = lambda t, s: spark.createDataFrame(t, s + ", x double, y double, u double, v double").withColumn("geom_wkb", box).drop("x", "y", "u", "v")
    adm2 = rows([(1, "A", 0.0, 0.0, 2.0, 1.0), (2, "A", 9.0, 9.0, 10.0, 10.0)], "adm2_rid long, adm0_iso string")
    adm1 = rows([("b", "first", "A", 0.0, 0.0, 1.0, 1.0), ("a", "second", "A", 1.0, 0.0, 2.0, 1.0), (None, "big", "A", 0.0, 0.0, 2.0, 1.0), ("z", "other", "B", 0.0, 0.0, 2.0, 1.0)], "adm1_id string, adm1_name string, adm0_iso string")
    got = {r["adm2_rid"]: (r["adm1_id"], r["adm1_name"]) for r in admin.enrich_districts(adm2, adm1).collect()}
    assert got == {1: ("a", "big"), 2: (None, None)}


def test_windows_read_their_own_chunks_only(spark):
    raster = surrogates.stored_raster(spark, "/root/testdata/sf0.001")
    names = lambda df: sorted(f.rsplit("/", 1)[1] for f in df.inputFiles())
    # one pixel: row 30, column 31 lies in chunk (1, 1) of each of three layers of chunks
    found = raster.cells((-10 + 0.25 * 31, 50 - 0.25 * 31, -10 + 0.25 * 32, 50 - 0.25 * 30))
    assert names(found) == ["0.1.1", "1.1.1", "2.1.1"] and found.count() == 7
    with pytest.raises(ValueError):
        raster.points(spark.createDataFrame([(99.0, 0.0)], "longitude double, latitude double"))


def test_tiles_are_directories(spark, tmp_path):
    box = geometry.box_wkb(*[F.col("x") + d for d in (0.0, 0.0, 0.1, 0.1)])
    rows = spark.createDataFrame([(0.2,), (0.4,), (2.3,)], "x double").select(F.monotonically_increasing_id().alias("cell_index"), F.lit("s").alias("source_id"), box.alias("source_geometry"), F.lit("flood").alias("hazard_name"), F.lit(2050).alias("horizon"), F.lit("p").alias("pathway"))
    got = ingest.write_tiles(rows, (0.0, 0.0, 4.0, 4.0), 1.0, str(tmp_path / "tiles")).collect()
    assert sorted((r["tile"], r["rows"]) for r in got) == [(0, 2), (10, 1)]
    assert sorted(x for x in os.listdir(tmp_path / "tiles") if x.startswith("tile=")) == ["tile=0", "tile=10"]


def test_resolution_estimates(spark):
    square = spark.createDataFrame([(10.0, 45.0, 12.0, 47.0)], "a double, b double, c double, d double").select(geometry.box_wkb("a", "b", "c", "d").alias("geom_wkb"))
    got = {r["resolution"]: (r["cell_count"], r["error"]) for r in indexing.resolution_estimates(square, [3, 4]).collect()}
    cells = indexing.polygon_candidates(square.withColumn("poly_rid", F.lit(1)), 3)
    geo = indexing.cell_geometries(cells).select(F.sum(geometry.polygon_area("cell_wkb"))).first()[0]
    assert got[3][0] == cells.count() and abs(got[3][1] - (geo - 4) / 4) < 0.02 and got[4][1] < got[3][1]


def test_index_file_and_geo_footer(spark, tmp_path):
    path = f"{work_folder(spark, 'index')}/wkt"
    spark.createDataFrame([(1, "POLYGON ((10 45, 11 45, 11 46, 10 46, 10 45))")], "rid int, geometry string").write.option("header", "true").csv(path)
    assert indexing.index_file(spark, path, "wkt", 4).filter("rid = '1'").count() > 0
    table = pa.table({"geometry": pa.array([struct.pack("<BIdd", 1, 1, 0.0, 0.0)], pa.binary())})
    pq.write_table(table.replace_schema_metadata({"geo": '{"primary_column": "geometry"}'}), tmp_path / "a.parquet")
    assert geo_metadata(spark, str(tmp_path)) == {"primary_column": "geometry"}
    pq.write_table(table.replace_schema_metadata({"geo": "{"}), tmp_path / "a.parquet")
    assert geo_metadata(spark, str(tmp_path)) is None


def test_lookup_is_shuffled_once(spark):
    c = spark.createDataFrame([("h", "A", 0.6), ("h", "B", 0.4), ("k", None, 1.0)], "hex_id string, adm0_iso string, pct double")
    out = lookup.lookup_contract(c, 8)
    assert _plan(out).count("Exchange") == 1
    (r,) = out.collect()
    assert (r["hex_id"], r["best_adm0"], r["adm0_count"], [x["adm0_iso"] for x in r["coverage"]]) == ("h", "A", 2, ["A", "B"])
