"""Joins whose sides look small to Spark but are not: nothing is broadcast that was not counted."""

from terragrist.plans import queries as q

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_assets_are_not_broadcast_by_an_estimate(spark):
    plan = _plan(q.portfolio_scenarios_all(spark, SF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_neither_are_those_of_impacts_and_guards(spark):
    for name in ("impact_context", "portfolio_judged"):
        plan = _plan(q.QUERIES[name](spark, SF))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_geometries_are_not_broadcast_by_an_estimate(spark):
    for name in ("coverage_of_cells", "coverage_exploded"):
        plan = _plan(q.QUERIES[name](spark, SF))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_points_and_clips_are_dealt_and_not_broadcast(spark):
    for name in ("point_in_polygon", "clip_area"):
        plan = _plan(q.QUERIES[name](spark, SF))
        assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_polygons_are_mended_in_many_tasks(spark):
    assert "REPARTITION_BY_NUM" in _plan(q.repaired_area(spark, SF))


def test_coverage_reads_its_polygons_once(spark):
    plan = _plan(q.coverage_exploded(spark, SF)).split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 3  # boxes, cells, polygons with what is told of them
