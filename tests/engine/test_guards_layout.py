"""Guards and values in one job, checked writes, and stores laid out by cell."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from terragrist.functions.geometry import write_polygon
from terragrist.operators.portfolio import Assets, Evaluation
from terragrist.schema import COLUMNS, HAZARD_SCHEMA, HazardMetadata
from terragrist.sources.hazard import HazardQuery, read_bucketed, read_hazard, read_metadata, write_bucketed, write_hazard

META = HazardMetadata(7, "metres", "flood depth", "tests", "1")


def row(cell, source="a", horizon=2050, pathway="p", geometry=None, location=2.0, scale=3.0):
    return (cell, source, geometry, "flood", horizon, pathway, "fitted", "gumbel_r", None, location, scale, None, None)


def hazard(spark, rows):
    return spark.createDataFrame(list(rows), HAZARD_SCHEMA)


def cells(spark, rows):
    return Assets(spark.createDataFrame(list(rows), "asset_id string, cell_index long, sector string"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_counts_equal_a_plain_count(spark):
    rng = random.Random(4)
    rows = [row(c, s, h, p) for c in range(30) for h in (2030, 2050) for p in ("x", "y") for s in "abc"[: rng.choice([0, 1, 1, 1, 2, 3])]]
    assets = [(f"n{i}", rng.randrange(40), None) for i in range(80)] + [("none", None, None)]
    e = Evaluation(hazard(spark, rows), cells(spark, assets)).return_periods([25])
    every = {(r[4], r[5]) for r in rows}
    have = {a: Counter((r[4], r[5]) for r in rows if r[0] == c) for a, c, _ in assets}
    assert {(r[0], r[2], r[3], r[4]) for r in e.match_counts().collect()} == {(a, *k, n) for a, x in have.items() for k, n in x.items()}
    assert {(r[0], r[2], r[3], r[4]) for r in e.ambiguous().collect()} == {(a, *k, n) for a, x in have.items() for k, n in x.items() if n > 1}
    assert sorted((r[0], r[2], r[3]) for r in e.missing().collect()) == sorted((a, *k) for a, x in have.items() for k in every - set(x))
    judged = {r["asset_id"]: (r["n_curves"], r["n_scenarios"], r["ambiguous"], r["incomplete"]) for r in e.judged(len(every)).collect()}
    assert judged == {a: (sum(x.values()), len(x), max(x.values(), default=1) > 1, len(x) < len(every)) for a, x in have.items()}


def test_write_has_one_join_and_no_exchange_after_it(shuffled):
    spark = shuffled
    e = Evaluation(hazard(spark, [row(i) for i in range(20)]), cells(spark, [(str(i), i, "s") for i in range(20)])).return_periods([25, 100])
    seen = Observation()
    out = e.guarded(seen)
    text = plan(out)
    assert text.count("Join ") == 1 and text.count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, e.evaluate().collect()))
    assert seen.get == {"assets": 20, "ambiguous": 0, "incomplete": 0}


def test_points_are_guarded_by_what_covers_them(spark):
    west, east = ([[(x, 0), (x + 1, 0), (x + 1, 2), (x, 2)]] for x in (0, 1))
    rows = [row(1, "w", geometry=write_polygon(west)), row(1, "e", geometry=write_polygon(east)), row(1, "any", horizon=2030)]
    at = spark.createDataFrame([("in", 0.5, 1.0), ("edge", 1.0, 1.0), ("out", 5.0, 1.0), ("null", None, 1.0)], "asset_id string, longitude double, latitude double")
    e = Evaluation(hazard(spark, rows), Assets(at), cell_of=lambda x, y: F.lit(1).cast("long")).return_periods([25])
    got = {r["asset_id"]: (r["n_curves"], r["ambiguous"], r["incomplete"]) for r in e.judged(2).collect()}
    assert got == {"in": (2, False, False), "edge": (3, True, False), "out": (1, False, True), "null": (1, False, True)}
    found = e.guarded(Observation()).filter("asset_id <> 'null'")
    assert sorted((r["asset_id"], r["source_id"], r["spatial_match"]) for r in found.collect()) == sorted((r["asset_id"], r["source_id"], r["spatial_match"]) for r in e.evaluate().filter("asset_id <> 'null'").collect())


@pytest.mark.parametrize("assets,what", [([("a", 1, ""), ("b", 2, "")], "ambiguous"), ([("a", 1, ""), ("c", 99, "")], "missing"), ([("a", 1, ""), ("a", 1, "")], "repeat")])
def test_refused_writes_leave_nothing(spark, tmp_path, assets, what):
    e = Evaluation(hazard(spark, [row(1), row(2), row(2, "b")]), cells(spark, assets)).return_periods([25])
    with pytest.raises((LookupError, ValueError), match=what):
        e.write(str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_many_missing_are_told_with_ten_rows(spark, tmp_path):
    e = Evaluation(hazard(spark, [row(1)]), cells(spark, [(f"x{i}", i, "") for i in range(1, 60)])).return_periods([25])
    with pytest.raises(LookupError, match="of 58 assets") as told:
        e.write(str(tmp_path / "out"))
    assert str(told.value).count("'asset_id'") == 10


# --- stores


def test_reads_start_no_job_and_foreign_rows_are_checked(spark, tmp_path):
    path, other = str(tmp_path / "own"), str(tmp_path / "other")
    rows = hazard(spark, [row(1), row(2)])
    write_hazard(rows, path, META)
    assert "raise_error" not in plan(read_hazard(spark, path))
    rows.withColumn("curve_scale", F.when(F.col("cell_index") == 2, -1.0).otherwise(1.0)).write.parquet(other)
    found = read_hazard(spark, other)
    assert "PushedFilters: [IsNotNull(cell_index), EqualTo(cell_index,1)]" in found.filter("cell_index = 1")._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert found.filter("cell_index = 1").count() == 1 and found.filter("cell_index = 1").first()["curve_scale"] == 1.0
    with pytest.raises(Exception, match="invalid curve parameters"):
        found.collect()
    with pytest.raises(ValueError, match="invalid hazard rows"):
        read_hazard(spark, other, verify=True)


def test_a_refused_store_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "h")
    write_hazard(hazard(spark, [row(1)]), path, META)
    for bad in ([row(5), row(5)], [row(5, scale=-1.0)]):
        with pytest.raises(ValueError):
            write_hazard(hazard(spark, bad), path, META, mode="overwrite")
    assert [r["cell_index"] for r in read_hazard(spark, path).collect()] == [1] and os.listdir(tmp_path) == ["h"]


def test_bucketed_store_is_joined_where_it_lies(shuffled, tmp_path):
    spark, path = shuffled, str(tmp_path / "b")
    rows = [row(c, horizon=h) for c in range(200) for h in (2030, 2050)]
    write_bucketed(hazard(spark, rows), path, META, buckets=8)
    stored = read_bucketed(spark, path)
    assert read_metadata(spark, path) == META and stored.columns == COLUMNS and stored.count() == 400
    assets = cells(spark, [(f"a{i}", i % 220, "s") for i in range(300)] + [(f"h{i}", 7, "s") for i in range(300)])
    e = Evaluation(stored, assets).return_periods([25])
    text = plan(e.evaluate())
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text  # that of the assets
    assert plan(e.judged(2)).count("Exchange hashpartitioning") == 1
    want = sorted(map(tuple, Evaluation(hazard(spark, rows), assets).return_periods([25]).evaluate().collect()))
    assert sorted(map(tuple, e.evaluate().collect())) == want == sorted(map(tuple, e.evaluate(spread=True).collect()))
    assert read_bucketed(spark, path, HazardQuery("flood", 2030)).count() == 200
    assert e._hot_cells(e.located(), 10) == [7] and 7 in e._hot_cells(e.located())


def test_a_layout_that_does_not_hold_is_refused(spark, tmp_path):
    path = str(tmp_path / "b")
    write_bucketed(hazard(spark, [row(c) for c in range(50)]), path, META, buckets=4)
    hazard(spark, [row(100)]).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="buckets"):
        read_bucketed(spark, path)
    write_hazard(hazard(spark, [row(1)]), str(tmp_path / "plain"), META)
    with pytest.raises(ValueError, match="no note"):
        read_bucketed(spark, str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="duplicate"):
        write_bucketed(hazard(spark, [row(1), row(1)]), str(tmp_path / "twice"), META, buckets=4)
