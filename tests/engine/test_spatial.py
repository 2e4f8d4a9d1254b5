"""The spatial join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrist.functions.geometry import box_wkb
from terragrist.operators import spatial
from terragrist.operators.admin import enrich_districts
from terragrist.operators.coverage import border_hexes

SCHEMA = "id long, g string, xmin double, ymin double, xmax double, ymax double"


def boxes(rng, n, spread, low, high, zero=0.1, whole=False):
    x, y = rng.normal(0, spread, n), rng.normal(0, spread, n)
    w, h = (np.where(rng.random(n) < zero, 0, np.exp(rng.uniform(np.log(low), np.log(high), n))) for _ in range(2))
    out = np.stack([x, y, x + w, y + h], axis=1)
    return np.round(out) if whole else out


def table(spark, b, rng, groups=("a", "b", None)):
    g = [groups[i] for i in rng.integers(0, len(groups), len(b))]
    return g, spark.createDataFrame([(i, g[i], *map(float, r)) for i, r in enumerate(b)], SCHEMA)


def brute(a, b, ga=None, gb=None):
    meet = (a[:, None, 0] <= b[None, :, 2]) & (a[:, None, 2] >= b[None, :, 0]) & (a[:, None, 1] <= b[None, :, 3]) & (a[:, None, 3] >= b[None, :, 1])
    out = list(zip(*(x.tolist() for x in np.nonzero(meet))))
    return sorted(p for p in out if ga is None or (ga[p[0]] is not None and ga[p[0]] == gb[p[1]]))


@pytest.mark.parametrize("spread,low,high,whole", [(10, 0.01, 100, False), (1000, 1e-6, 1e-3, False), (20, 0.5, 8, True), (0.001, 1e-9, 1e3, False), (0, 1, 4, False)])
def test_equals_all_pairs(spark, spread, low, high, whole, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 16)
    rng = np.random.default_rng(int(spread) + 3)
    a, b = boxes(rng, 300, spread, low, high, whole=whole), boxes(rng, 250, spread, low * 3, high, whole=whole)
    ga, left = table(spark, a, rng)
    gb, right = table(spark, b, rng)
    right = right.withColumnRenamed("id", "other")
    assert sorted(map(tuple, spatial.box_pairs(left, right, "id", "other").collect())) == brute(a, b)
    assert sorted(map(tuple, spatial.box_pairs(left, right, "id", "other", on=["g"]).collect())) == brute(a, b, ga, gb)


def test_no_key_holds_a_group(spark, monkeypatch):
    """Half of the boxes lie on one spot, one covers all others."""
    monkeypatch.setattr(spatial, "BLOCK", 20)
    rng = np.random.default_rng(1)
    a = np.concatenate([boxes(rng, 400, 50, 0.1, 1), boxes(rng, 400, 0, 0.1, 1)])
    b = np.concatenate([[[-1e4, -1e4, 1e4, 1e4]], boxes(rng, 60, 50, 0.1, 1)])
    _, left = table(spark, a, rng, ("a",))
    _, right = table(spark, b, rng, ("a",))
    right = right.withColumnRenamed("id", "other")
    for d, keys in ((x, k) for l, r, k in [spatial.dealt(left, right, "id", "other", ["g"])] for x in (l, r)):
        assert d.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 60  # blocks of 20 by a hash, not by a count
    assert sorted(map(tuple, spatial.box_pairs(left, right, "id", "other", on=["g"]).collect())) == brute(a, b)


def test_a_box_lies_in_few_squares(spark):
    rng = np.random.default_rng(2)
    a = boxes(rng, 500, 100, 1e-3, 1e3)
    _, left = table(spark, a, rng)
    l, r, _ = spatial.dealt(left, left.withColumnRenamed("id", "other"), "id", "other")
    levels = l.select("l_level").distinct().count()
    assert l.count() <= 500 * 4 * levels and r.count() <= 500 * 4 * levels


def test_odd_boxes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", 0.0, 0.0, 1.0, 1.0), (1, "a", 0.0, 0.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0, 1.0), (3, "a", None, 0.0, 1.0, 1.0), (4, "a", 1.0, 0.0, 0.0, 1.0), (5, "a", nan, 0.0, nan, 1.0), (6, "a", -inf, 0.0, inf, 1.0), (7, "a", 5.0, 5.0, 6.0, 6.0)]
    left = spark.createDataFrame(rows, SCHEMA).withColumn("gx", F.lit("clash")).withColumn("l_id", F.lit("clash")).withColumn("level", F.lit("clash"))
    right = left.withColumnRenamed("id", "other")
    got = sorted(map(tuple, spatial.box_pairs(left, right, "id", "other").collect()))
    assert got == sorted([(1, 1)] * 4 + [(1, 2)] * 2 + [(2, 1)] * 2 + [(2, 2), (7, 7)])
    assert spatial.box_pairs(left.limit(0), right, "id", "other").count() == spatial.box_pairs(left, right.limit(0), "id", "other").count() == 0
    points = spark.createDataFrame([(i, "a", float(i % 3), 0.0, float(i % 3), 0.0) for i in range(30)], SCHEMA)
    assert spatial.box_pairs(points, points.withColumnRenamed("id", "other"), "id", "other").count() == 300


def test_districts_and_borders_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    two, one = np.round(boxes(rng, 60, 5, 0.5, 3, zero=0), 2), np.round(boxes(rng, 12, 5, 2, 9, zero=0), 2)
    g2, left = table(spark, two, rng, ("x", "y"))
    g1, right = table(spark, one, rng, ("x", "y"))
    wkb = box_wkb("xmin", "ymin", "xmax", "ymax")
    adm2 = left.select(F.col("id").alias("adm2_rid"), F.col("g").alias("adm0_iso"), wkb.alias("geom_wkb"))
    adm1 = right.select(F.concat(F.lit("d"), (100 + F.col("id")).cast("string")).alias("adm1_id"), F.lit("n").alias("adm1_name"), F.col("g").alias("adm0_iso"), wkb.alias("geom_wkb"))
    got = {r["adm2_rid"]: r["adm1_id"] for r in enrich_districts(adm2, adm1).collect()}
    for i, a in enumerate(two):
        area = lambda b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))  # noqa: B023, E731
        best = max(((round(area(b), 9), -k) for k, b in enumerate(one) if g1[k] == g2[i] and area(b) > 1e-9), default=None)
        assert got[i] == (None if best is None else f"d{100 - best[1]}")
    countries = right.select(F.col("id").cast("string").alias("adm0_iso"), *spatial.BOUNDS)
    cells = left.select(F.col("id").cast("string").alias("hex_id"), *spatial.BOUNDS)
    near = {r[0] for r in border_hexes(cells, cells.filter("hex_id = '7'").select("hex_id"), countries, "3").collect()}
    assert near == {str(i) for i, k in brute(two, one) if k != 3} | {"7"}


def test_few_pairs_are_looked_at(spark):
    """Each box meets about one other; squares that hold as many as a block may would have all of them meet hundreds."""
    rng = np.random.default_rng(4)
    a, b = (np.concatenate([p, p + rng.uniform(1, 2, (2000, 2))], axis=1) for p in (rng.uniform(0, 100, (2000, 2)) for _ in range(2)))
    left, right = table(spark, a, rng)[1], table(spark, b, rng)[1].withColumnRenamed("id", "other")
    l, r, keys = spatial.dealt(left, right, "id", "other")
    assert l.join(r, keys).count() <= 40 * len(a)
    assert sorted(map(tuple, spatial.box_pairs(left, right, "id", "other").collect())) == brute(a, b)


def test_boxes_are_read_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ROWS_PER_FILE", 100, raising=False)
    rng = np.random.default_rng(5)
    left = table(spark, boxes(rng, 1000, 10, 0.1, 1), rng)[1].coalesce(1)
    for d in spatial.dealt(left, left.withColumnRenamed("id", "other"), "id", "other")[:2]:
        assert len(d.inputFiles()) == 10
