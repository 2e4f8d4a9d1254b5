"""Hazard store, portfolio evaluation, streaming."""

import pytest
from pyspark.sql import functions as F

from terragrist import schema
from terragrist.functions.geometry import write_polygon
from terragrist.operators.portfolio import Assets, Evaluation, scenario_filter, with_quantiles
from terragrist.schema import HAZARD_SCHEMA, HazardMetadata, Source
from terragrist.sources.hazard import HazardQuery, LocalProvider, read_hazard, read_metadata, write_hazard
from terragrist.streaming import portfolio as live

META = HazardMetadata(7, "metres", "flood depth", "tests", "1", (Source("p", "fixture"),))


def _row(cell=1, source="a", horizon=2050, pathway="ssp585", geometry=None, location=2.0, scale=3.0, name="flood", kind="fitted", atom=None, x0=None):
    return (cell, source, geometry, name, horizon, pathway, kind, "gumbel_r", None, location, scale, atom, x0)


def _hazard(spark, *rows):
    return spark.createDataFrame(list(rows), HAZARD_SCHEMA)


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "h")
    write_hazard(_hazard(spark, _row(2, "b", kind="hurdle", atom=0.5, x0=0.0), _row(1, "a", 2030, "ssp245")), path, META)
    assert read_metadata(spark, path) == META
    assert [r["cell_index"] for r in read_hazard(spark, path).collect()] == [1, 2]
    p = LocalProvider(spark, path)
    assert p.list_hazards() == ["flood"] and p.metadata("flood") == META and p.read(HazardQuery("flood", 2050)).count() == 1
    with pytest.raises(LookupError, match="unknown hazard"):
        p.metadata("wind")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "h")
    write_hazard(_hazard(spark, *[_row(i) for i in range(50)]), path, META)
    df = read_hazard(spark, path, HazardQuery("flood", cell_index=7), columns=["curve_location"])
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(cell_index,7)" in plan and "curve_scale" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("rows,what", [([_row(), _row()], "duplicate"), ([_row(name="")], "hazard_name is empty"), ([_row(scale=-1.0)], "invalid curve")])
def test_invalid_rows_are_refused(spark, tmp_path, rows, what):
    with pytest.raises(ValueError, match=what):
        write_hazard(_hazard(spark, *rows), str(tmp_path / "h"), META)


def test_metadata_rules():
    for bad in ({"resolution": 16}, {"unit": " "}, {"probability_convention": "exceedance"}):
        with pytest.raises(ValueError):
            HazardMetadata(**{"resolution": 7, "unit": "m", "semantics": "s", "producer": "p", "creation_version": "1"} | bad)
    assert HazardMetadata.from_json(META.to_json()) == META


def test_cell_assets_and_columns(spark):
    assets = spark.createDataFrame([("x", 1, "office")], "asset_id string, hazard_cell long, sector string")
    e = Evaluation(_hazard(spark, _row(), _row(horizon=2030)), Assets(assets, cell_col="hazard_cell")).select(horizons=[2050]).return_periods([25, 100])
    e.guard()
    out = e.evaluate()
    assert out.columns == ["asset_id", "sector", "cell_index", "hazard_name", "horizon", "pathway", "source_id", "spatial_match", "value_rp25", "value_rp100"]
    assert out.count() == 1


def test_points_are_refined_by_geometry(spark):
    near = write_polygon([[(6.95, 50.92), (6.97, 50.92), (6.97, 50.95), (6.95, 50.95)]])
    far = write_polygon([[(0, 0), (1, 0), (1, 1), (0, 1)]])
    assets = spark.createDataFrame([("x", 6.9603, 50.9375)], "asset_id string, longitude double, latitude double")
    e = Evaluation(_hazard(spark, _row(source="near", geometry=near), _row(source="far", geometry=far), _row(source="any", horizon=2030)), Assets(assets), cell_of=lambda x, y: F.lit(1).cast("long")).return_periods([25])
    assert sorted((r["source_id"], r["spatial_match"]) for r in e.evaluate().collect()) == [("any", "h3_cell"), ("near", "exact_geometry")]


def test_guards(spark):
    assets = lambda *r: Assets(spark.createDataFrame(list(r), "asset_id string, cell_index long"))
    h = _hazard(spark, _row())
    with pytest.raises(ValueError, match="null or repeat"):
        Evaluation(h, assets(("x", 1), ("x", 1))).return_periods([25]).guard()
    with pytest.raises(LookupError, match="missing"):
        Evaluation(h, assets(("x", 1), ("y", 2))).return_periods([25]).guard()
    with pytest.raises(LookupError, match="ambiguous"):
        Evaluation(_hazard(spark, _row(), _row(source="b")), assets(("x", 1))).return_periods([25]).guard()
    Evaluation(h, assets(("y", 2))).select(horizons=[1999]).return_periods([25]).guard()
    with pytest.raises(ValueError):
        Assets(spark.createDataFrame([("x",)], "asset_id string"))
    with pytest.raises(TypeError):
        scenario_filter("horizon", [True])


def test_reserved_columns_do_not_pass(spark):
    a = Assets(spark.createDataFrame([("x", 1.0, 2.0, 3, 2050, "s")], "asset_id string, longitude double, latitude double, cell_index long, horizon int, sector string"))
    assert a.passthrough == ("sector",) and a.by_point


def test_stream_of_assets(spark, tmp_path):
    spark.createDataFrame([("x", 1), ("y", 9)], "asset_id string, cell_index long").write.parquet(str(tmp_path / "in"))
    arriving = live.stream_assets(spark, str(tmp_path / "in"), "asset_id string, cell_index long")
    e = Evaluation(_hazard(spark, _row()), Assets(spark.createDataFrame([], "asset_id string, cell_index long"))).return_periods([25])
    q = live.start(e, arriving, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r["asset_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x"]


def test_write_keeps_metadata_and_empty_results(spark, tmp_path):
    e = Evaluation(_hazard(spark, _row()), Assets(spark.createDataFrame([], "asset_id string, cell_index long"))).return_periods([25])
    e.write(str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 0 and "value_rp25" in back.columns and "return_periods" in back.schema[0].metadata["terragrist.evaluation"]


def test_duplicate_keys(spark):
    assert schema.duplicate_keys(_hazard(spark, _row(), _row(), _row(5))).count() == 1


def test_quantiles_without_a_join(spark):
    c = _hazard(spark, _row(), _row(2, kind="hurdle", atom=0.7, x0=0.5)).withColumn("province", F.lit("p"))
    out = with_quantiles(c, [0.6], ["depth_m"], ["cell_index", "province"])
    assert out.columns == ["cell_index", "province", "depth_m"]
    assert {r[0]: round(r[2], 6) for r in out.collect()} == {1: 4.015181, 2: 0.5}
    with pytest.raises(ValueError):
        with_quantiles(c, [0.5, 0.6], ["a", "a"], [])
