"""What a task of a lookup sorts does not grow with the table."""

from terragrist.operators import lookup
from terragrist.plans import queries as q


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(lookup, "ROWS_PER_TASK", 200, raising=False)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity > 0").count()
    plan = q.lookup_contract(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-rows // 200)}), REPARTITION_BY_NUM" in plan


def test_so_do_the_ranges_of_a_sorted_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "ROWS_PER_TASK", 100)
    rows = spark.range(1000).selectExpr("format_string('%03d', id % 7) as h3_r3", "format_string('%04d', id) as hex_id", "id as n").repartition(3)
    path = str(tmp_path / "sorted.parquet")
    out = lookup.write_lookup(rows, path, sort=True)
    assert sorted(out.collect()) == sorted(rows.collect())
    files = sorted((tmp_path / "sorted.parquet").glob("*.parquet"))
    found = [[(r["h3_r3"], r["hex_id"]) for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(found) > 5 and max(map(len, found)) < 250 and all(f == sorted(f) for f in found)
    assert sum(found, []) == sorted(sum(found, []))
    assert lookup.write_lookup(rows.limit(0), str(tmp_path / "none.parquet"), sort=True).count() == 0
