"""Queries that write a store, read it back through the library, and use what they read."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from terragrist.functions import geometry
from terragrist.functions.impacts import ImpactSpec, LinearImpact
from terragrist.operators import admin, coverage as cov, indexing, lookup, tiles
from terragrist.operators.portfolio import Assets, Evaluation, write_quantile, write_quantiles
from terragrist.plans import surrogates as s
from terragrist.plans.queries import _BOXES, _CONTRACT, _OVERLAP, _PORTFOLIO, _RPS, _SHARED, PERIODS, _box_candidates, _boxes, _r6, _rounded, _value_sql, query, r6
from terragrist.schema import COLUMNS, HazardMetadata, Source
from terragrist.sources.hazard import HazardQuery, LocalProvider, read_bucketed, read_hazard, read_metadata, write_bucketed, write_hazard, write_hazard_batches
from terragrist.sources.inventory import Inventory
from terragrist.sources.publish import work_folder, write_bytes
from terragrist.sources.vector import asset_source, measure, read_union, read_vector

_ABOUT = HazardMetadata(7, "metres", "flood depth", "tests", "1", (Source("fixture", "depth", "array/depth"),))


def _store(spark, sf_dir) -> str:
    path = f"{work_folder(spark, 'hazard')}/curves.parquet"
    write_hazard(s.curves(spark, sf_dir), path, _ABOUT)
    return path


@query(f"{s.with_sql('curves')} SELECT * FROM curves WHERE hazard_name = 'flood' AND horizon = 2030 AND pathway = 'ssp585'")
def hazard_store(spark, sf_dir):
    return read_hazard(spark, _store(spark, sf_dir), HazardQuery("flood", 2030, "ssp585")).drop("source_geometry")


@query(f"{s.with_sql('curves')} SELECT * FROM curves WHERE pathway = 'ssp245' OR horizon = 2050")
def hazard_batches(spark, sf_dir):
    path, c = f"{work_folder(spark, 'hazard')}/batches.parquet", s.curves(spark, sf_dir)
    write_hazard_batches(spark, [c.filter("pathway = 'ssp245'"), c.filter("pathway = 'ssp585' and horizon = 2050")], path, _ABOUT)
    return read_hazard(spark, path).drop("source_geometry")


@query("SELECT 'flood' AS hazard_name, 'metres' AS unit, 'flood depth' AS semantics, CAST(7 AS INTEGER) AS resolution, 'array/depth' AS uri, CAST((SELECT count(*) FROM part) AS BIGINT) AS n")
def hazard_provider(spark, sf_dir):
    p = LocalProvider(spark, _store(spark, sf_dir))
    (name,), about = p.list_hazards(), p.metadata("flood")
    assert about == read_metadata(spark, p.path)
    rows = p.read(HazardQuery(name, 2050, "ssp585")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.lit(name).alias("hazard_name"), F.lit(about.unit).alias("unit"), F.lit(about.semantics).alias("semantics"), F.lit(about.resolution).alias("resolution"), F.lit(about.sources[0].uri).alias("uri"), "n")


@query(f"{s.with_sql('assets', 'curves')} {_PORTFOLIO}, {_RPS}, 'metres' AS unit FROM assets JOIN curves USING (cell_index) WHERE pathway = 'ssp585'")
def portfolio_written(spark, sf_dir):
    e = Evaluation(read_hazard(spark, _store(spark, sf_dir)), Assets(s.assets(spark, sf_dir), cell_col="cell_index", passthrough=("sector",))).select(pathways=["ssp585"]).return_periods(PERIODS)
    found = e.write(f"{work_folder(spark, 'evaluation')}/values.parquet", unit="metres")
    said = json.loads(found.schema["asset_id"].metadata["terragrist.evaluation"])
    return _rounded(found).withColumn("unit", F.lit(said["unit"]))


@query(f"{s.with_sql('assets', 'curves')} {_PORTFOLIO}, {_RPS} FROM assets JOIN curves USING (cell_index) WHERE horizon = 2050")
def portfolio_bucketed(spark, sf_dir):
    """Curves in buckets by cell, which assets join without a shuffle of the curves."""
    path = f"{work_folder(spark, 'hazard')}/bucketed.parquet"
    write_bucketed(s.curves(spark, sf_dir), path, _ABOUT, buckets=8)
    e = Evaluation(read_bucketed(spark, path), Assets(s.assets(spark, sf_dir), cell_col="cell_index", passthrough=("sector",)))
    return _rounded(e.select(horizons=[2050]).return_periods(PERIODS).evaluate(skewnorm=False, spread=True))


@query(f"{s.with_sql('curves')} SELECT cell_index, horizon, pathway, {_r6('least(1.0, greatest(0.0, 0.01 * (' + _value_sql('0.96') + ') + 0.05))')} AS share_rp25, {_r6('least(1.0, greatest(0.0, 0.01 * (' + _value_sql('0.99') + ') + 0.05))')} AS share_rp100 FROM curves")
def quantiles_written(spark, sf_dir):
    path = f"{work_folder(spark, 'quantiles')}/wide.parquet"
    n = write_quantiles(s.curves(spark, sf_dir), [0.96, 0.99], path, columns=["share_rp25", "share_rp100"], passthrough=["cell_index", "horizon", "pathway"], spec=ImpactSpec(LinearImpact(0.01, 0.05), "linear", "1", "damage share"), metadata={"unit": "1"})
    out = spark.read.parquet(path)
    assert out.count() == n
    return out.select("cell_index", "horizon", "pathway", r6("share_rp25").alias("share_rp25"), r6("share_rp100").alias("share_rp100"))


@query(f"{s.with_sql('curves')} SELECT cell_index, {_r6(_value_sql('0.99'))} AS depth_m FROM curves WHERE horizon = 2050 AND pathway = 'ssp585'")
def quantile_written(spark, sf_dir):
    path = f"{work_folder(spark, 'quantiles')}/one.parquet"
    write_quantile(s.curves(spark, sf_dir).filter("horizon = 2050 and pathway = 'ssp585'"), 0.99, path, passthrough=["cell_index"])
    return spark.read.parquet(path).withColumn("depth_m", r6("depth_m"))


@query(_CONTRACT)
def lookup_store(spark, sf_dir):
    catalog = lookup.LookupCatalog(work_folder(spark, "lookup"))
    lookup.write_lookup(lookup.lookup_contract(s.hex_coverage(spark, sf_dir), 8, include_coverage=False), catalog.lookup_uri(8), sort=True)
    t = catalog.assignments(spark, 8)
    return t.withColumn("adm0_pct", r6("adm0_pct")).withColumn("adm1_pct", r6("adm1_pct"))


_RECT = f"WITH {_BOXES} SELECT CAST(poly_rid AS VARCHAR) AS rid, x0 AS xmin, y0 AS ymin, CAST(x1 AS DOUBLE) AS xmax, CAST(y1 AS DOUBLE) AS ymax FROM polys"


def _rectangles(spark, sf_dir):
    """The supplier rectangles, as text."""
    p, _ = _boxes(spark, sf_dir)
    edge = lambda a, b: F.concat_ws(" ", a, b)
    x0, y0, x1, y1 = (F.col(c).cast("string") for c in ("xmin", "ymin", "xmax", "ymax"))
    return p.withColumn("wkt", F.concat(F.lit("POLYGON (("), F.concat_ws(", ", edge(x0, y0), edge(x1, y0), edge(x1, y1), edge(x0, y1), edge(x0, y0)), F.lit("))")))


def _bounds(df):
    return df.withColumn("e", geometry.extent("geom_wkb")).select(F.col("rid").cast("string").alias("rid"), "e.xmin", "e.ymin", "e.xmax", "e.ymax")


@query(_RECT)
def vector_wkt(spark, sf_dir):
    path = f"{work_folder(spark, 'vector')}/wkt"
    _rectangles(spark, sf_dir).select(F.col("poly_rid").alias("rid"), F.col("wkt").alias("geometry")).write.option("header", "true").csv(path)
    return _bounds(read_vector(spark, path, "wkt"))


@query(_RECT)
def vector_wkb(spark, sf_dir):
    path = f"{work_folder(spark, 'vector')}/wkb"
    _rectangles(spark, sf_dir).select(F.col("poly_rid").alias("rid"), F.hex("geom_wkb").alias("geometry")).write.option("header", "true").csv(path)
    return _bounds(read_vector(spark, path, "wkb"))


@query(_RECT)
def vector_geojson(spark, sf_dir):
    """One collection a file, of the rectangles whose id ends alike."""
    path = f"{work_folder(spark, 'vector')}/json"
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))])
    f = _rectangles(spark, sf_dir).select((F.col("poly_rid") % 10).alias("file"), F.struct(F.lit("Feature").alias("type"), F.struct(F.col("poly_rid").alias("rid")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")).alias("f"))
    f = f.groupBy("file").agg(F.collect_list("f").alias("features")).select("file", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    f.repartition("file").write.partitionBy("file").text(path)
    return _bounds(read_vector(spark, [f"{path}/file={i}" for i in range(10)], "geojson"))


@query(f"{_RECT.replace(' FROM polys', ', CAST(poly_rid % 2 AS INTEGER) AS part FROM polys')}")
def vector_parquet(spark, sf_dir):
    """Two files with other columns, united by name, with the partition that they stand in."""
    path, p = f"{work_folder(spark, 'vector')}/parquet", _rectangles(spark, sf_dir)
    p.filter("poly_rid % 2 = 0").select(F.col("poly_rid").alias("rid"), F.col("geom_wkb").alias("geometry")).write.parquet(f"{path}/part=0")
    p.filter("poly_rid % 2 = 1").select(F.col("geom_wkb").alias("geometry"), F.col("poly_rid").alias("rid"), F.lit("x").alias("more")).write.parquet(f"{path}/part=1")
    size, rows = measure(spark, path, "geometry")
    united = read_union(spark, f"{path}/part=0", f"{path}/part=1", base=path)
    assert size > 0 and rows == united.count() == read_vector(spark, [f"{path}/part=0", f"{path}/part=1"], "geoparquet").count()
    e = united.withColumn("e", geometry.extent("geometry"))
    return e.select(F.col("rid").cast("string").alias("rid"), "e.xmin", "e.ymin", "e.xmax", "e.ymax", F.col("part").cast("int").alias("part"))


@query("SELECT p_brand AS hazard_type, 'parts' AS indicator_id, lower(replace(p_brand, '#', '')) || '/ssp585/' || y || '/' || p_size AS path, 'u' || p_size AS units FROM (SELECT DISTINCT p_brand, p_size FROM part), (VALUES (2030), (2050)) t(y)")
def inventory_paths(spark, sf_dir):
    """A resource for each brand, with the sizes of its parts as a parameter; written as an inventory, read, selected and resolved for all sizes and two years."""
    path = f"{work_folder(spark, 'inventory')}/inventory.json"
    rows = s.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("size"))
    folder = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/{scenario}/{year}/{size}"))
    years = F.array(F.struct(F.lit("ssp585").alias("id"), F.array(F.lit(2030), F.lit(2050)).alias("years")))
    resource = F.struct(F.col("p_brand").alias("hazard_type"), F.lit("parts").alias("indicator_id"), folder.alias("path"), F.struct("size").alias("params"), years.alias("scenarios"))
    said = [r[0] for r in rows.select(F.to_json(resource)).collect()]  # one a brand
    write_bytes(spark, path, ('{"resources": [' + ",".join(said) + "]}").encode())
    found = Inventory.read(spark, path)
    out = []
    for r in found.find(indicator_id="parts"):
        one = found.select(hazard_type=r.hazard_type)
        out += [(r.hazard_type, r.indicator_id, one.choose("ssp585", y, size=n).path, f"u{n}") for n in one.parameters["size"] for y in one.scenarios["ssp585"]]
    return spark.createDataFrame(out, "hazard_type string, indicator_id string, path string, units string")


_SITES = """sites AS (SELECT event_id AS asset_id, longitude, latitude, CAST((floor(longitude / 10) + 18) * 100 + floor((latitude + 90) / 10) AS BIGINT) AS cell_index FROM points),
halves AS (SELECT DISTINCT cell_index, h.source_id, 'flood' AS hazard_name, 2050 AS horizon, 'ssp585' AS pathway, 'fitted' AS curve_kind, 'gumbel_r' AS curve_type, CAST(NULL AS DOUBLE) AS curve_shape,
  CAST(cell_index % 40 AS DOUBLE) AS curve_location, CAST(2 AS DOUBLE) AS curve_scale, CAST(NULL AS DOUBLE) AS curve_atom_probability, CAST(NULL AS DOUBLE) AS curve_atom_location,
  CASE h.source_id WHEN 'west' THEN cell_index // 100 * 10 - 180 WHEN 'east' THEN cell_index // 100 * 10 - 175 END AS x0
  FROM sites, (VALUES ('whole'), ('west'), ('east')) h(source_id) WHERE (cell_index % 3 = 0) = (h.source_id = 'whole'))"""


@query(
    f"{s.with_sql('points')}, {_SITES} SELECT asset_id, longitude, latitude, cell_index, hazard_name, horizon, pathway, source_id, CASE WHEN x0 IS NULL THEN 'h3_cell' ELSE 'exact_geometry' END AS spatial_match, {_RPS} "
    "FROM sites JOIN halves USING (cell_index) WHERE x0 IS NULL OR longitude BETWEEN x0 AND x0 + 5"
)
def portfolio_polygons(spark, sf_dir):
    """Points on squares of ten degrees, of which some have a curve for each half: the polygon decides which one holds."""
    cell_of = lambda x, y: ((F.floor(x / 10) + 18) * 100 + F.floor((y + 90) / 10)).cast("long")
    sites = s.points(spark, sf_dir).select(F.col("event_id").alias("asset_id"), "longitude", "latitude")
    k, whole = F.col("cell_index"), F.col("source_id") == "whole"
    c = sites.select(cell_of(F.col("longitude"), F.col("latitude")).alias("cell_index")).distinct()
    c = c.withColumn("source_id", F.explode(F.when(k % 3 == 0, F.array(F.lit("whole"))).otherwise(F.array(F.lit("west"), F.lit("east")))))
    x0, y0 = F.floor(k / 100) * 10 - 180 + F.when(F.col("source_id") == "east", 5).otherwise(0), k % 100 * 10 - 90
    box = F.when(~whole, geometry.box_wkb(*[v.cast("double") for v in (x0, y0, x0 + 5, y0 + 10)]))
    none = lambda n: F.lit(None).cast("double").alias(n)
    c = c.select(k, "source_id", box.alias("source_geometry"), F.lit("flood").alias("hazard_name"), F.lit(2050).alias("horizon"), F.lit("ssp585").alias("pathway"), F.lit("fitted").alias("curve_kind"), F.lit("gumbel_r").alias("curve_type"), none("curve_shape"), (k % 40).cast("double").alias("curve_location"), F.lit(2.0).alias("curve_scale"), none("curve_atom_probability"), none("curve_atom_location"))
    assert c.columns == COLUMNS
    return _rounded(Evaluation(c, Assets(asset_source(spark, sites)), cell_of=cell_of).return_periods(PERIODS).evaluate(skewnorm=False))


@query(f"WITH {_BOXES}, c AS (SELECT hex, poly_rid, {_OVERLAP} / 0.09 AS pct, cx <= x1 AND cx + 0.3 >= x0 AND cy <= y1 AND cy + 0.3 >= y0 AS near FROM squares, polys) SELECT CAST(hex AS VARCHAR) AS hex_id FROM c WHERE near GROUP BY hex HAVING count(*) = 1 AND max(pct) > 1e-12 AND max(pct) < 1 - 1e-9")
def edge_hexes(spark, sf_dir):
    """Cells with one candidate that does not hold all of them."""
    p, c = _boxes(spark, sf_dir)
    return cov.edge_hexes(_box_candidates(p, c), p, c)


@query(
    f"WITH {_BOXES}, c AS (SELECT hex, {_OVERLAP} / 0.09 AS pct, count(*) OVER (PARTITION BY hex) AS cnt FROM squares, polys WHERE cx <= x1 AND cx + 0.3 >= x0 AND cy <= y1 AND cy + 0.3 >= y0) "
    "SELECT 'flat' AS mode, count(*) FILTER (WHERE cnt = 1) AS single, count(DISTINCT hex) FILTER (WHERE cnt > 1) AS competing, count(*) FILTER (WHERE cnt > 1) AS competing_ops, count(*) FILTER (WHERE cnt = 1 AND pct < 1 - 1e-9) AS edge_singles, "
    "count(DISTINCT hex) FILTER (WHERE cnt > 1 OR pct < 1 - 1e-9) AS needed_hexes, count(*) FILTER (WHERE pct > 1e-9) AS coverage_rows, count(*) FILTER (WHERE pct > 1e-9 AND pct < 1 - 1e-9) AS partial_pct_rows FROM c"
)
def coverage_written(spark, sf_dir):
    """What the coverage writer counts, and the rows that it wrote but for slivers of rounding."""
    p, c = _boxes(spark, sf_dir)
    path = f"{work_folder(spark, 'written')}/coverage.parquet"
    told = cov.write_coverage(_box_candidates(p, c), p, path, path=["adm0_iso"], resolution=5, cache=c)
    rows = spark.read.parquet(path).filter("pct > 1e-9").agg(F.count(F.lit(1)).alias("coverage_rows"), F.count_if(F.col("pct") < 1 - 1e-9).alias("partial_pct_rows"))
    counts = ("single", "competing", "competing_ops", "edge_singles", "needed_hexes")
    return rows.select(F.lit(told["mode"]).alias("mode"), *[F.lit(told[k]).cast("long").alias(k) for k in counts], "coverage_rows", "partial_pct_rows")


@query(
    f"WITH {_BOXES}, one AS (SELECT * FROM polys WHERE poly_rid % 3 = 0), pairs AS (SELECT a.poly_rid AS rid, b.poly_rid AS other, {_SHARED} AS area FROM polys a JOIN one b ON a.adm0 = b.adm0) "
    "SELECT poly_rid AS adm2_rid, CAST(adm0 AS VARCHAR) AS adm0_iso, adm1_id, adm1_name FROM polys LEFT JOIN (SELECT rid, arg_max('d' || (1000 + other), struct_pack(a := area, o := -other)) AS adm1_id, arg_max('District ' || other, struct_pack(a := area, o := -other)) AS adm1_name FROM pairs WHERE area > 1e-12 GROUP BY 1) ON rid = poly_rid"
)
def districts(spark, sf_dir):
    """Every rectangle with the one of its country, of each third, that shares most with it."""
    p, _ = _boxes(spark, sf_dir)
    p = p.select(F.col("poly_rid").alias("adm2_rid"), "adm0_iso", "geom_wkb")
    one = p.filter("adm2_rid % 3 = 0").select(F.concat(F.lit("d"), (1000 + F.col("adm2_rid")).cast("string")).alias("adm1_id"), F.concat(F.lit("District "), F.col("adm2_rid").cast("string")).alias("adm1_name"), "adm0_iso", "geom_wkb")
    return admin.enrich_districts(p, one).drop("geom_wkb")


@query(f"WITH {_BOXES}, country AS (SELECT adm0, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM polys GROUP BY 1) SELECT CAST(hex AS VARCHAR) AS hex_id FROM (SELECT hex, cx, cy, CAST(0.3 AS DOUBLE) AS third FROM squares) WHERE hex % 50 = 1 OR EXISTS (SELECT 1 FROM country WHERE adm0 BETWEEN 1 AND 2 AND cx <= c AND cx + third >= a AND cy <= d AND cy + third >= b)")
def border_with_edges(spark, sf_dir):
    p, c = _boxes(spark, sf_dir)
    p = p.filter("adm0_iso in ('1', '2', '7')")
    return cov.border_hexes(c.drop("cell_wkb"), c.filter("cast(hex_id as long) % 50 = 1").select("hex_id"), cov.envelopes(p, "adm0_iso"), "7")


@query(f"WITH {_BOXES} SELECT CAST(hex AS VARCHAR) AS hex_id, {_r6('cx')} AS xmin, {_r6('cy')} AS ymin FROM squares WHERE EXISTS (SELECT 1 FROM polys WHERE cx <= x1 AND cx + 0.3 >= x0 AND cy <= y1 AND cy + 0.3 >= y0)")
def cached_cells(spark, sf_dir):
    """Geometries of candidate cells, all of them known."""
    p, c = _boxes(spark, sf_dir)
    found = indexing.cell_geometries(_box_candidates(p, c), cache=c).withColumn("e", geometry.extent("cell_wkb"))
    return found.select("hex_id", r6("e.xmin").alias("xmin"), r6("e.ymin").alias("ymin"))


@query(
    "SELECT chr(30) || '{\"type\":\"Feature\",\"tippecanoe\":{\"layer\":\"' || l || '\",\"minzoom\":' || z || ',\"maxzoom\":9},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || (s_suppkey % 180) || '.5,' || s_nationkey || '.25]},\"properties\":{\"s_suppkey\":' || s_suppkey || '}}' || chr(10) AS feature "
    "FROM supplier, (VALUES ('all', 0), ('even', 3)) t(l, z) WHERE s_suppkey % 7 <> 0 AND (l = 'all' OR s_suppkey % 2 = 0)"
)
def feature_layers(spark, sf_dir):
    """Two layers; rows without a geometry are left out."""
    k = F.col("s_suppkey")
    point = F.when(k % 7 != 0, geometry.point_wkb(k % 180 + 0.5, F.col("s_nationkey") + 0.25))
    rows = s.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", point.alias("Geom"))
    keep = ("s_suppkey",)
    return tiles.features([tiles.Layer("all", rows, tiles.ZoomRange(0, 9), keep), tiles.Layer("even", rows.filter("s_suppkey % 2 = 0"), tiles.ZoomRange.of([3, 9]), keep)])
