"""Coverage written directly and by parents, and what it counts."""

import numpy as np
import pytest

from terragrist.functions import geometry
from terragrist.operators import coverage, indexing


def _polygons(spark):
    ring = lambda x0, y0, x1, y1: geometry.write_polygon([np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)])
    rows = [(1, "A", ring(10.0, 45.0, 10.5, 45.4)), (2, "B", ring(10.4, 45.0, 10.9, 45.4)), (3, "C", None)]
    return spark.createDataFrame(rows, "poly_rid long, adm0_iso string, geom_wkb binary")


def test_by_parents_and_directly(spark, tmp_path):
    polys = _polygons(spark)
    candidates = indexing.polygon_candidates(polys.filter("poly_rid < 3"), 6)
    whole = coverage.write_coverage(candidates, polys, str(tmp_path / "a"), path=["adm0_iso"], resolution=6)
    assert whole["mode"] == "hierarchical" and whole["interior_parents"] + whole["boundary_parents"] == whole["parent_touch"] >= whole["parent_geoms"]
    assert whole["needed_hexes"] == whole["edge_singles"] + whole["competing"] and whole["competing_ops"] >= 2 * whole["competing"] > 0
    # no cell may be so far in that its parent, of resolution 5, lies within as well: the finer parents decide the same shares
    fine = coverage.write_coverage(candidates, polys, str(tmp_path / "b"), path=["adm0_iso"], resolution=6, parent_resolution=5)
    assert fine["interior_parents"] > 0 and fine["boundary_children"] < fine["single"]
    plain = coverage.exploded_coverage(candidates, polys, indexing.cell_geometries(candidates), ["adm0_iso"])
    rows = lambda df: {(r["hex_id"], r["adm0_iso"]): r["pct"] for r in df.collect()}
    want = rows(plain)
    for name, stats in (("a", whole), ("b", fine)):
        got = rows(spark.read.parquet(str(tmp_path / name)))
        assert set(got) == set(want) and len(got) == stats["coverage_rows"]
        # children are not exactly nested, so a cell at the border may be taken as whole
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) or got[k] == 1.0 for k in got)
        assert stats["partial_pct_rows"] == sum(v < 1 for v in got.values())
    with pytest.raises(FileExistsError):
        coverage.write_coverage(candidates, polys, str(tmp_path / "a"), path=["adm0_iso"], resolution=6)


def test_directly_below_six_and_from_a_cache(spark, tmp_path):
    polys = _polygons(spark)
    candidates = indexing.polygon_candidates(polys.filter("poly_rid < 3"), 5)
    cache = indexing.cell_geometries(candidates).limit(3)
    extra = candidates.unionByName(spark.createDataFrame([(None, 1), ("x", None), ("85", 99)], "hex_id string, poly_rid long"))
    stats = coverage.write_coverage(extra, polys, str(tmp_path / "c"), path=["adm0_iso"], resolution=5, cache=cache)
    plain = coverage.exploded_coverage(candidates, polys, indexing.cell_geometries(candidates), ["adm0_iso"])
    assert stats["mode"] == "flat" and "parent_touch" not in stats and stats["coverage_rows"] == plain.count()
    got, want = ({(r["hex_id"], r["adm0_iso"]): r["pct"] for r in d.collect()} for d in (spark.read.parquet(str(tmp_path / "c")), plain))
    assert got == pytest.approx(want, abs=1e-9)
    for resolution, parent in ((5, 5), (16, None), (3, 4)):
        with pytest.raises(ValueError):
            coverage.write_coverage(candidates, polys, str(tmp_path / "d"), path=["adm0_iso"], resolution=resolution, parent_resolution=parent)


def test_without_candidates(spark, tmp_path):
    polys = _polygons(spark)
    none = indexing.polygon_candidates(polys.filter("poly_rid < 3"), 6).limit(0)
    stats = coverage.write_coverage(none, polys, str(tmp_path / "e"), path=["adm0_iso"], resolution=6)
    assert stats.pop("mode") == "hierarchical" and set(stats.values()) == {0}


def test_cached_geometries_come_by_one_join(spark):
    cells = indexing.polygon_candidates(_polygons(spark).filter("poly_rid < 3"), 5)
    made = {r["hex_id"]: bytes(r["cell_wkb"]) for r in indexing.cell_geometries(cells).collect()}
    first, second = sorted(made)[:2]
    cache = spark.createDataFrame([(first, b"own"), (second, None), ("elsewhere", b"no")], "hex_id string, cell_wkb binary")
    found = indexing.cell_geometries(cells.select("hex_id").unionByName(spark.createDataFrame([(None,)], "hex_id string")), cache=cache)
    got = {r["hex_id"]: r["cell_wkb"] and bytes(r["cell_wkb"]) for r in found.collect()}
    assert got == made | {first: b"own", second: None, None: None} and len(made) > 3
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan
