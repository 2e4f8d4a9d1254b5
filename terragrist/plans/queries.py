"""The registered queries over the driver's tables, with the same results as DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terragrist import schema
from terragrist.functions import cells, fitting, geometry, hexgrid, projections
from terragrist.functions.curves import FAMILIES, quantile
from terragrist.functions.impacts import ImpactSpec, LinearImpact, PiecewiseLinearImpact, SigmoidImpact
from terragrist.functions.repair import repaired
from terragrist.operators import coverage as cov
from terragrist.operators import indexing, lookup, spatial, tiles
from terragrist.operators.portfolio import Assets, Evaluation
from terragrist.operators.union_area import union_areas
from terragrist.plans import surrogates as s
from terragrist.sources import geotiff, raster
from terragrist.sources.hazard import HazardQuery, hazard_names, select_rows, sort_rows
from terragrist.sources.publish import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six decimals by the same arithmetic in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5).cast("double") / 1e6


def _r6(c: str) -> str:
    return f"CAST(floor(({c}) * 1e6 + 0.5) AS DOUBLE) / 1e6"


def _value_sql(p: str) -> str:
    """The closed forms at probability p."""
    q = f"(CASE WHEN curve_kind = 'hurdle' THEN ({p} - curve_atom_probability) / (1 - curve_atom_probability) ELSE {p} END)"
    inner = f"CASE WHEN {q} > 0 AND {q} < 1 THEN {q} END"
    e, u = f"(-ln({inner}))", f"(-ln(1 - ({inner})))"
    L, S, c = "curve_location", "curve_scale", "curve_shape"
    body = (
        f"CASE curve_type WHEN 'gumbel_r' THEN {L} - {S} * ln({e}) WHEN 'gumbel_l' THEN {L} + {S} * ln({u}) "
        f"WHEN 'genextreme' THEN {L} + {S} * (1 - pow({e}, {c})) / {c} WHEN 'weibull_min' THEN {L} + {S} * pow({u}, 1 / {c}) "
        f"WHEN 'weibull_max' THEN {L} - {S} * pow({e}, 1 / {c}) WHEN 'genpareto' THEN {L} + {S} * (exp({c} * {u}) - 1) / {c} END"
    )
    return f"CASE WHEN curve_kind = 'hurdle' AND {p} <= curve_atom_probability THEN curve_atom_location ELSE {body} END"


PERIODS = (25, 100, 250)
_RPS = ", ".join(f"{_r6(_value_sql(f'(1 - 1 / CAST({p} AS DOUBLE))'))} AS value_rp{p}" for p in PERIODS)


def _evaluation(spark: SparkSession, sf_dir: str, **passthrough) -> Evaluation:
    return Evaluation(s.curves(spark, sf_dir), Assets(s.assets(spark, sf_dir), cell_col="cell_index", **passthrough)).return_periods(PERIODS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c.startswith("value_rp") else c for c in df.columns])


_PORTFOLIO = "SELECT asset_id, sector, cell_index, hazard_name, horizon, pathway, source_id, 'h3_cell' AS spatial_match"


@query(f"{s.with_sql('assets', 'curves')} {_PORTFOLIO}, {_RPS} FROM assets JOIN curves USING (cell_index) WHERE hazard_name = 'flood' AND horizon IN (2050) AND pathway IN ('ssp585')")
def portfolio_return_periods(spark, sf_dir):
    e = _evaluation(spark, sf_dir, passthrough=("sector",)).select(hazards=["flood"], horizons=[2050], pathways=["ssp585"])
    return _rounded(e.evaluate(skewnorm=False))


@query(f"{s.with_sql('assets', 'curves')} {_PORTFOLIO}, {_RPS} FROM assets JOIN curves USING (cell_index)")
def portfolio_scenarios_all(spark, sf_dir):
    return _rounded(_evaluation(spark, sf_dir, passthrough=("sector",)).evaluate(skewnorm=False))


@query(f"{s.with_sql('assets', 'curves')} {_PORTFOLIO}, {_RPS} FROM assets JOIN curves USING (cell_index) WHERE curve_kind = 'hurdle'")
def portfolio_hurdle(spark, sf_dir):
    e = Evaluation(s.curves(spark, sf_dir).filter("curve_kind = 'hurdle'"), Assets(s.assets(spark, sf_dir), cell_col="cell_index", passthrough=("sector",))).return_periods(PERIODS)
    return _rounded(e.evaluate(skewnorm=False))


@query(f"{s.with_sql('assets', 'curves')} {_PORTFOLIO}, {_RPS} FROM assets JOIN curves USING (cell_index) WHERE false")
def portfolio_empty_selection(spark, sf_dir):
    return _rounded(_evaluation(spark, sf_dir, passthrough=("sector",)).select(horizons=[]).evaluate(skewnorm=False))


def _quantiles(family: str) -> tuple[Query, str]:
    ps = (0.0, 0.1, 0.5, 0.96, 0.99, 0.998, 1.0)
    mid = [p for p in ps if 0 < p < 1]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = s.curves(spark, sf_dir).filter((F.col("curve_type") == family) & (F.col("horizon") == 2050))
        return c.select("cell_index", "pathway", *[r6(quantile(p)).alias(f"q{i}") for i, p in enumerate(mid)], *[F.abs(quantile(p)).cast("string").isin("Infinity", "NaN").alias(f"open{int(p)}") for p in (0.0, 1.0)])

    low = {"weibull_min": False, "genpareto": False}.get(family, True)
    high = {"weibull_max": False, "genextreme": False}.get(family, True)
    atom = "curve_kind = 'hurdle'"
    sql = f"{s.with_sql('curves')} SELECT cell_index, pathway, {', '.join(f'{_r6(_value_sql(str(p)))} AS q{i}' for i, p in enumerate(mid))}, CASE WHEN {atom} THEN false ELSE {str(low).lower()} END AS open0, {str(high).lower()} AS open1 FROM curves WHERE curve_type = '{family}' AND horizon = 2050"
    run.__name__ = f"quantiles_{family}"
    return run, sql


for _f in s.FAMILY_BY_KEY:
    _run, _sql = _quantiles(_f)
    query(_sql)(_run)


@query()
def quantiles_skewnorm(spark, sf_dir):
    c = indexing.spread(s.curves(spark, sf_dir).filter("horizon = 2050 and pathway = 'ssp585'")).withColumn("curve_type", F.lit("skewnorm")).withColumn("curve_shape", (F.col("cell_index") % 9 - 4).cast("double"))
    return c.select("cell_index", "curve_shape", *[r6(quantile(p, skewnorm=True)).alias(n) for n, p in (("q50", 0.5), ("q99", 0.99))])


_IMPACTS = {
    "impact_linear": (LinearImpact(0.01, 0.05), lambda v: f"least(1.0, greatest(0.0, 0.01 * ({v}) + 0.05))"),
    "impact_piecewise": (
        PiecewiseLinearImpact((0.0, 20.0, 60.0), (0.0, 0.3, 1.0)),
        lambda v: f"CASE WHEN ({v}) <= 0 THEN 0.0 WHEN ({v}) <= 20 THEN (({v}) - 0) * 0.015 WHEN ({v}) <= 60 THEN 0.3 + (({v}) - 20) * 0.0175 ELSE 1.0 END",
    ),
    "impact_sigmoid": (SigmoidImpact(30.0, 0.1), lambda v: f"1.0 / (1.0 + exp(-0.1 * (({v}) - 30.0)))"),
}


def _impact(name: str) -> None:
    impact, sql = _IMPACTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _evaluation(spark, sf_dir, passthrough=("sector",)).select(horizons=[2030]).impact(ImpactSpec(impact, name, "1", "damage share"))
        return _rounded(e.evaluate(skewnorm=False).drop("spatial_match"))

    run.__name__ = name
    cols = ", ".join(f"{_r6(sql(_value_sql(f'(1 - 1 / CAST({p} AS DOUBLE))')))} AS value_rp{p}" for p in PERIODS)
    query(f"{s.with_sql('assets', 'curves')} SELECT asset_id, sector, cell_index, hazard_name, horizon, pathway, source_id, {cols} FROM assets JOIN curves USING (cell_index) WHERE horizon = 2030")(run)


for _n in _IMPACTS:
    _impact(_n)


@query(f"{s.with_sql('assets', 'curves')} SELECT asset_id, horizon, pathway, {_r6('(' + _value_sql('(1 - 1 / CAST(100 AS DOUBLE))') + ') / (1 + abs(coalesce(baseline, 100)) / 1000)')} AS value_rp100 FROM assets JOIN curves USING (cell_index)")
def impact_context(spark, sf_dir):
    class Relative:
        def column(self, value, context):
            return value / (1 + F.abs(context["historic_mean"]) / 1000)

    spec = ImpactSpec(Relative(), "relative", "1", "value against a local mean", columns={"historic_mean": "baseline"}, defaults={"historic_mean": 100.0})
    e = _evaluation(spark, sf_dir, passthrough=("sector", "baseline")).return_periods([100]).impact(spec)
    return _rounded(e.evaluate(skewnorm=False).select("asset_id", "horizon", "pathway", "value_rp100"))


@query(f"{s.with_sql('assets', 'curves')} SELECT asset_id, hazard_name, horizon, pathway, count(*) AS n FROM assets JOIN (SELECT * FROM curves UNION ALL SELECT * REPLACE ('t' AS source_id) FROM curves WHERE cell_index % 10 = 3) USING (cell_index) GROUP BY ALL HAVING count(*) > 1")
def portfolio_ambiguous(spark, sf_dir):
    c = s.curves(spark, sf_dir)
    twice = c.unionByName(c.filter("cell_index % 10 = 3").withColumn("source_id", F.lit("t")))
    return Evaluation(twice, Assets(s.assets(spark, sf_dir), cell_col="cell_index", passthrough=())).ambiguous()


@query(f"{s.with_sql('assets', 'curves')} SELECT asset_id, hazard_name, horizon, pathway FROM assets, (SELECT DISTINCT hazard_name, horizon, pathway FROM curves) w WHERE cell_index % 7 = 0 AND horizon = 2030 AND pathway = 'ssp245'")
def portfolio_missing(spark, sf_dir):
    c = s.curves(spark, sf_dir).filter("not (cell_index % 7 = 0 and horizon = 2030 and pathway = 'ssp245')")
    return Evaluation(c, Assets(s.assets(spark, sf_dir), cell_col="cell_index", passthrough=())).missing()


_UNEVEN = f"{s.with_sql('assets', 'curves')}, uneven AS (SELECT * FROM curves WHERE NOT (cell_index % 7 = 0 AND horizon = 2030) UNION ALL SELECT * REPLACE ('t' AS source_id) FROM curves WHERE cell_index % 10 = 3)"


def uneven_curves(spark, sf_dir) -> DataFrame:
    """Curves of which some lack and some come twice."""
    c = s.curves(spark, sf_dir)
    return c.filter("not (cell_index % 7 = 0 and horizon = 2030)").unionByName(c.filter("cell_index % 10 = 3").withColumn("source_id", F.lit("t")))


@query(
    f"{_UNEVEN}, n AS (SELECT asset_id, CAST(count(source_id) AS INTEGER) AS n_curves, CAST(count(DISTINCT CASE WHEN source_id IS NOT NULL THEN struct_pack(h := hazard_name, o := horizon, p := pathway) END) AS INTEGER) AS n_scenarios "
    "FROM assets LEFT JOIN uneven USING (cell_index) GROUP BY 1) SELECT *, n_curves > n_scenarios AS ambiguous, n_scenarios < 4 AS incomplete FROM n"
)
def portfolio_judged(spark, sf_dir):
    """What the guards say of every asset, as they count it while values are written."""
    e = Evaluation(uneven_curves(spark, sf_dir), Assets(s.assets(spark, sf_dir), cell_col="cell_index", passthrough=())).return_periods(PERIODS)
    return e.judged(len(e.scenarios())).select("asset_id", "n_curves", "n_scenarios", "ambiguous", "incomplete")


@query(f"{s.with_sql('curves')} SELECT * FROM curves WHERE hazard_name = 'flood' AND horizon = 2050 AND pathway = 'ssp245' AND cell_index = 42")
def hazard_filter(spark, sf_dir):
    return select_rows(s.curves(spark, sf_dir), HazardQuery("flood", 2050, "ssp245", 42)).drop("source_geometry")


@query("SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'wind' ELSE 'flood' END AS hazard_name FROM part")
def hazard_list(spark, sf_dir):
    return hazard_names(s.curves(spark, sf_dir).withColumn("hazard_name", F.when(F.col("cell_index") % 3 == 0, "wind").otherwise("flood")))


@query(f"{s.with_sql('curves')} SELECT hazard_name, horizon, pathway, cell_index, source_id, count(*) AS n FROM (SELECT * FROM curves UNION ALL SELECT * FROM curves WHERE cell_index % 11 = 0) GROUP BY ALL HAVING count(*) > 1")
def hazard_dup_keys(spark, sf_dir):
    c = s.curves(spark, sf_dir)
    return schema.duplicate_keys(c.unionByName(c.filter("cell_index % 11 = 0")))


@query(
    f"{s.with_sql('curves')} SELECT cell_index, horizon, pathway, CASE WHEN cell_index % 13 = 0 THEN 'pathway is empty' ELSE 'invalid curve parameters' END AS fault FROM curves "
    "WHERE cell_index % 13 = 0 OR cell_index % 17 = 0 OR (cell_index % 19 = 0 AND curve_kind = 'fitted')"
)
def hazard_invalid_rows(spark, sf_dir):
    k = F.col("cell_index")
    c = s.curves(spark, sf_dir).withColumn("pathway0", F.col("pathway")).withColumn("pathway", F.when(k % 13 == 0, " ").otherwise(F.col("pathway")))
    c = c.withColumn("curve_scale", F.when(k % 17 == 0, -1.0).otherwise(F.col("curve_scale")))
    c = c.withColumn("curve_atom_location", F.when((k % 19 == 0) & (F.col("curve_kind") == "fitted"), 1.0).otherwise(F.col("curve_atom_location")))
    return schema.invalid_rows(c).select("cell_index", "horizon", F.col("pathway0").alias("pathway"), "fault")


@query(f"{s.with_sql('curves')} SELECT hazard_name, horizon, pathway, cell_index, source_id FROM curves")
def hazard_sorted(spark, sf_dir):
    return sort_rows(s.curves(spark, sf_dir)).select(*schema.ROW_KEY)


_BEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hex_id ORDER BY pct DESC NULLS LAST, adm0_iso NULLS LAST, adm1_id NULLS LAST, adm1_name NULLS LAST, adm2_id NULLS LAST, adm2_name NULLS LAST) AS r FROM {t}) WHERE r = 1)"


@query(f"{s.with_sql('coverage')} SELECT hex_id, adm0_iso AS best_adm0, adm1_id AS best_adm1_id, adm1_name AS best_adm1_name, adm2_id AS best_adm2_id, adm2_name AS best_adm2_name, pct AS best_pct FROM {_BEST.format(t='coverage')}")
def lookup_best_path(spark, sf_dir):
    return lookup.best_paths(lookup.conform_coverage(s.coverage(spark, sf_dir)))


@query(f"{s.with_sql('coverage')} SELECT hex_id, adm0_iso, adm1_id, adm1_name, {_r6('least(1.0, sum(pct))')} AS adm1_pct FROM coverage GROUP BY ALL")
def lookup_rollups(spark, sf_dir):
    return lookup.rollup_adm1(lookup.conform_coverage(s.coverage(spark, sf_dir))).withColumn("adm1_pct", r6("adm1_pct"))


@query(
    f"{s.with_sql('coverage')} SELECT hex_id, CAST(count(DISTINCT adm0_iso) AS INTEGER) AS adm0_count, CAST(count(DISTINCT struct_pack(a := adm0_iso, b := coalesce(adm1_id, adm1_name))) AS INTEGER) AS adm1_count, CAST(count(*) AS INTEGER) AS adm2_count FROM coverage GROUP BY hex_id"
)
def lookup_counts(spark, sf_dir):
    return lookup.candidate_counts(lookup.conform_coverage(s.coverage(spark, sf_dir)))


_CONTRACT = f"""{s.with_sql('hexes')}, best AS {_BEST.format(t='hexes')},
a0 AS (SELECT hex_id, adm0_iso, least(1.0, sum(pct)) AS adm0_pct FROM hexes GROUP BY ALL),
a1 AS (SELECT hex_id, adm0_iso, adm1_id, adm1_name, least(1.0, sum(pct)) AS adm1_pct FROM hexes GROUP BY ALL),
n AS (SELECT hex_id, CAST(count(DISTINCT adm0_iso) AS INTEGER) AS adm0_count, CAST(count(DISTINCT struct_pack(a := adm0_iso, b := coalesce(adm1_id, adm1_name))) AS INTEGER) AS adm1_count, CAST(count(*) AS INTEGER) AS adm2_count FROM hexes GROUP BY hex_id)
SELECT b.hex_id, {', '.join(f"lower(printf('%x', ((('0x' || b.hex_id)::BIGINT & ~(15::BIGINT << 52)) | ({r}::BIGINT << 52) | {(1 << 3 * (15 - r)) - 1}))) AS h3_r{r}" for r in range(3, 8))},
b.adm0_iso AS best_adm0, b.adm1_id AS best_adm1_id, b.adm1_name AS best_adm1_name, b.adm2_id AS best_adm2_id, b.adm2_name AS best_adm2_name, b.pct AS best_pct,
{_r6('adm0_pct')} AS adm0_pct, {_r6('adm1_pct')} AS adm1_pct, adm0_count, adm1_count, adm2_count,
adm0_count = 1 AND adm0_pct >= 0.999999 AS is_adm0_interior, adm1_count = 1 AND adm1_pct >= 0.999999 AS is_adm1_interior, adm2_count = 1 AND b.pct >= 0.999999 AS is_adm2_interior
FROM best b JOIN n USING (hex_id) JOIN a0 ON a0.hex_id = b.hex_id AND a0.adm0_iso = b.adm0_iso
JOIN a1 ON a1.hex_id = b.hex_id AND a1.adm0_iso = b.adm0_iso AND a1.adm1_id IS NOT DISTINCT FROM b.adm1_id AND a1.adm1_name IS NOT DISTINCT FROM b.adm1_name"""


@query(_CONTRACT)
def lookup_contract(spark, sf_dir):
    t = lookup.lookup_contract(s.hex_coverage(spark, sf_dir), 8, include_coverage=False)
    return t.withColumn("adm0_pct", r6("adm0_pct")).withColumn("adm1_pct", r6("adm1_pct"))


_ORDERED = "string_agg({x}, ';' ORDER BY pct DESC, adm0_iso NULLS LAST, adm1_id NULLS LAST, adm2_id NULLS LAST)"


@query(f"{s.with_sql('coverage')} SELECT hex_id, CAST(count(*) AS INTEGER) AS n, {_ORDERED.format(x="adm0_iso || '/' || coalesce(adm1_id, '-') || '/' || adm2_id || '/' || CAST(round(pct * 50) AS INTEGER)")} AS paths FROM coverage GROUP BY hex_id")
def lookup_nested(spark, sf_dir):
    n = lookup.nested_coverage(lookup.conform_coverage(s.coverage(spark, sf_dir)))
    path = lambda c: F.concat_ws("/", c["adm0_iso"], F.coalesce(c["adm1_id"], F.lit("-")), c["adm2_id"], F.round(c["pct"] * 50).cast("int").cast("string"))
    return n.select("hex_id", F.size("coverage").alias("n"), F.array_join(F.transform("coverage", path), ";").alias("paths"))


@query(f"{s.with_sql('coverage')} SELECT DISTINCT hex_id FROM coverage WHERE adm0_iso = 'A'")
def country_cells_nested(spark, sf_dir):
    c = lookup.conform_coverage(s.coverage(spark, sf_dir))
    return lookup.country_cells(lookup.best_paths(c).join(lookup.nested_coverage(c), "hex_id"), "a")


@query(f"{s.with_sql('coverage')} SELECT DISTINCT hex_id FROM coverage WHERE adm0_iso = 'R' AND pct > 0")
def country_cells_exploded(spark, sf_dir):
    return lookup.country_cells(s.coverage(spark, sf_dir), "r")


_CELLS = f"(SELECT DISTINCT l_orderkey, {s.CELL_SQL} AS cell FROM lineitem)"


def _cells(spark, sf_dir):
    return s.table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().withColumn("cell", s.cell_of_key(F.col("l_orderkey")))


@query(f"SELECT l_orderkey, (cell & ~(15::BIGINT << 52)) | (5::BIGINT << 52) | {(1 << 30) - 1} AS p5, (cell & ~(15::BIGINT << 52)) | {(1 << 45) - 1} AS p0, CAST((cell >> 45) & 127 AS INTEGER) AS base, CAST((cell >> 21) & 7 AS INTEGER) AS d8 FROM {_CELLS}")
def cell_parent(spark, sf_dir):
    c = F.col("cell")
    return _cells(spark, sf_dir).select("l_orderkey", cells.parent(c, 5).alias("p5"), cells.parent(c, 0).alias("p0"), cells.base_cell(c).alias("base"), cells.digit(c, 8).alias("d8"))


@query(f"SELECT l_orderkey, lower(printf('%x', cell)) AS text, cell AS back, CAST(8 AS INTEGER) AS res FROM {_CELLS}")
def cell_to_string(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("text", cells.to_string(F.col("cell")))
    return c.select("l_orderkey", "text", cells.from_string(F.col("text")).alias("back"), cells.resolution(F.col("cell")).alias("res"))


@query(f"SELECT lower(printf('%x', (cell & ~(15::BIGINT << 52)) | {(1 << 45) - 1})) AS h3_r0, count(*) AS n FROM {_CELLS} GROUP BY 1")
def partitioned_counts(spark, sf_dir):
    catalog = lookup.LookupCatalog(work_folder(spark, "lookup"))
    lookup.write_partitioned(_cells(spark, sf_dir).select(cells.to_string(F.col("cell")).alias("hex_id")), catalog.partitioned_root(8), 8)
    return catalog.assignments(spark, 8, 0).groupBy("h3_r0").agg(F.count(F.lit(1)).alias("n"))


_PIXEL = '"row", col, -10 + 0.25 * (col + 0.5) AS longitude, 50 - 0.25 * ("row" + 0.5) AS latitude, axis_index'


def _located(df: DataFrame) -> DataFrame:
    return df.select("row", "col", (-10 + 0.25 * (F.col("col") + 0.5)).alias("longitude"), (50 - 0.25 * (F.col("row") + 0.5)).alias("latitude"), "axis_index", "value")


@query(f"{s.with_sql('pixels')} SELECT {_PIXEL}, value FROM pixels")
def raster_scan(spark, sf_dir):
    return s.stored_raster(spark, sf_dir).scan().filter("value is not null").select("row", "col", "longitude", "latitude", "axis_index", "value")


@query(f'{s.with_sql("pixels")} SELECT {_PIXEL}, value FROM pixels WHERE "row" >= 20 AND "row" < 41 AND col >= 8 AND col < 31')
def raster_window(spark, sf_dir):
    return s.stored_raster(spark, sf_dir).scan((-8.0, 39.9, -2.4, 45.0)).filter("value is not null").select("row", "col", "longitude", "latitude", "axis_index", "value")


@query(f'{s.with_sql("pixels")} SELECT event_id, axis_index, p.value FROM (SELECT event_id, event_id % 97 AS "row", user_id % 89 AS col FROM events) e JOIN pixels p USING ("row", col)')
def raster_point_sample(spark, sf_dir):
    e = s.table(spark, sf_dir, "events").select("event_id", (-10 + 0.25 * (F.col("user_id") % 89 + 0.5)).alias("longitude"), (50 - 0.25 * (F.col("event_id") % 97 + 0.5)).alias("latitude"))
    return s.stored_raster(spark, sf_dir).points(e).filter("value is not null").select("event_id", "axis_index", "value")


@query(f"""{s.with_sql("pixels")} SELECT "row", col, CAST(count(*) AS INTEGER) AS n, string_agg(axis_index || ':' || CAST(round(value * 100) AS BIGINT), ' ' ORDER BY axis_index) AS curve FROM pixels GROUP BY "row", col""")
def raster_curves(spark, sf_dir):
    c = s.stored_raster(spark, sf_dir).curves().withColumn("k", F.filter("knots", lambda x: x["value"].isNotNull())).filter(F.size("k") > 0)
    text = F.transform("k", lambda x: F.concat(x["axis_index"].cast("string"), F.lit(":"), F.round(x["value"] * 100).cast("long").cast("string")))
    return c.select("row", "col", F.size("k").alias("n"), F.array_join(text, " ").alias("curve"))


@query(f'{s.with_sql("pixels")} SELECT "row", col, {_r6("1 - 1.0 / [2, 5, 10, 25, 50, 100, 1000][axis_index + 1]")} AS probability, value FROM pixels')
def raster_knots(spark, sf_dir):
    return s.stored_raster(spark, sf_dir).knots().withColumn("probability", r6("probability"))


@query(f'{s.with_sql("pixels")} SELECT {_PIXEL.replace(", axis_index", "")}, CAST(CAST(value AS REAL) AS DOUBLE) AS value FROM pixels WHERE axis_index = 0 AND "row" BETWEEN 10 AND 49 AND col BETWEEN 4 AND 63 AND value < 90000'.replace('"row", col, ', ""))
def geotiff_scan(spark, sf_dir):
    path = s.stored_geotiff(spark, sf_dir)
    found = geotiff.read_geotiff(spark, path, (-9.0, 37.5, 6.0, 47.5), mask=F.col("value") < 90000, assumed_crs="EPSG:4326")
    return found.withColumn("value", F.col("value").cast("double"))


@query(f'{s.with_sql("pixels")} SELECT {_PIXEL.replace(", axis_index", "")}, CAST(CAST(value AS REAL) AS DOUBLE) AS value FROM pixels WHERE axis_index = 0 AND col BETWEEN 20 AND 39 AND "row" >= 40'.replace('"row", col, ', ""))
def geotiff_filtered(spark, sf_dir):
    """Limits of longitude and latitude that are filters of the query, which the source reads its blocks by."""
    found = geotiff.read_geotiff(spark, s.stored_geotiff(spark, sf_dir), assumed_crs="EPSG:4326").filter("longitude > -5 and longitude <= 0 and latitude < 40")
    return found.withColumn("value", F.col("value").cast("double"))


@query("SELECT user_id AS cell, max(value) AS value FROM events GROUP BY user_id")
def reduce_max(spark, sf_dir):
    return raster.reduce_cells(s.table(spark, sf_dir, "events"), "max", cell="user_id").withColumnRenamed("user_id", "cell")


@query("SELECT user_id AS cell, min(value) AS value FROM events GROUP BY user_id")
def reduce_min(spark, sf_dir):
    return raster.reduce_cells(s.table(spark, sf_dir, "events"), "min", cell="user_id").withColumnRenamed("user_id", "cell")


def _fit_sql(z: str, where: str = "true", p: str = "probability") -> str:
    return f"""{s.with_sql("knots")}, k AS (SELECT l_suppkey, value, {z.format(p="q")} AS z FROM (SELECT *, {p} AS q FROM knots WHERE {where})),
line AS (SELECT l_suppkey, regr_intercept(value, z) AS loc, regr_slope(value, z) AS sc, count(*) AS n, max(value) - min(value) AS spread FROM k GROUP BY 1),
d AS (SELECT l_suppkey, loc, sc, n, spread, sqrt(avg(pow(value - loc - sc * z, 2))) AS rmse FROM k JOIN line USING (l_suppkey) GROUP BY ALL)
SELECT l_suppkey, floor(loc * 100 + 0.5) / 100 AS location, floor(sc * 100 + 0.5) / 100 AS scale, n, floor(rmse / spread * 1e4 + 0.5) / 1e4 AS normalized_rmse FROM d"""


def _fit(spark, sf_dir, policy):
    f = fitting.fit_gumbel(s.knots(spark, sf_dir), ["l_suppkey"], policy)
    near = lambda c, k: (F.floor(F.col(c) * k + 0.5) / k).alias(c)
    return f.select("l_suppkey", near("location", 100), near("scale", 100), "n", near("normalized_rmse", 1e4))


@query(_fit_sql("-ln(-ln({p}))"))
def fit_gumbel_r(spark, sf_dir):
    return _fit(spark, sf_dir, fitting.FitPolicy("gumbel_r"))


@query(_fit_sql("ln(-ln(1 - {p}))"))
def fit_gumbel_l(spark, sf_dir):
    return _fit(spark, sf_dir, fitting.FitPolicy("gumbel_l"))


@query(_fit_sql("-ln(-ln({p}))", "probability > 0.5", "(probability - 0.5) / 0.5"))
def fit_hurdle(spark, sf_dir):
    return _fit(spark, sf_dir, fitting.FitPolicy("gumbel_r", atom_probability=0.5))


@query()
def fit_genextreme(spark, sf_dir):
    k = s.knots(spark, sf_dir)
    return fitting.fit_curves(k, ["l_suppkey"], fitting.FitPolicy("genextreme", max_normalized_rmse=1.0, on_failure="skip"))


@query(
    f"{s.with_sql('points')}, area AS (SELECT floor(min(longitude)) AS a, floor(min(latitude)) AS b, ceil(max(longitude)) AS c, ceil(max(latitude)) AS d, CAST(ceil((c - a) / 7) AS BIGINT) AS nx, CAST(ceil((d - b) / 7) AS BIGINT) AS ny FROM points), "
    "grid AS (SELECT area.*, unnest(range(nx * ny)) AS k FROM area), owned AS (SELECT least(ny - 1, CAST(floor((latitude - b) / 7) AS BIGINT)) * nx + least(nx - 1, CAST(floor((longitude - a) / 7) AS BIGINT)) AS k, count(*) AS n FROM points, area GROUP BY 1) "
    "SELECT CAST(k AS INTEGER) AS tile, CAST(a + 7 * (k % nx) AS DOUBLE) AS x0, CAST(b + 7 * (k // nx) AS DOUBLE) AS y0, CAST(least(c, a + 7 * (k % nx + 1)) AS DOUBLE) AS x1, CAST(least(d, b + 7 * (k // nx + 1)) AS DOUBLE) AS y1, coalesce(n, 0) AS n FROM grid LEFT JOIN owned USING (k)"
)
def tile_grid(spark, sf_dir):
    """The tiles of the area of all points, with the points that each owns."""
    p = s.points(spark, sf_dir)
    area = p.agg(F.floor(F.min("longitude")), F.floor(F.min("latitude")), F.ceil(F.max("longitude")), F.ceil(F.max("latitude"))).first()
    if area[0] is None:
        return spark.createDataFrame([], "tile int, x0 double, y0 double, x1 double, y1 double, n long")
    bounds = tuple(float(x) for x in area)
    grid = spark.createDataFrame([(i, *t) for i, t in enumerate(raster.tile_bounds(bounds, 7.0))], "tile int, x0 double, y0 double, x1 double, y1 double")
    owned = p.groupBy(raster.owning_tile("longitude", "latitude", bounds, 7.0).alias("tile")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(owned, "tile", "left").select("tile", "x0", "y0", "x1", "y1", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{s.with_sql('points')} SELECT CAST(greatest(0, least(16, floor((latitude + 85) / 10))) * 36 + greatest(0, least(35, floor((longitude + 180) / 10))) AS INTEGER) AS tile, count(*) AS n FROM points GROUP BY 1")
def tile_ownership(spark, sf_dir):
    p = s.points(spark, sf_dir)
    return p.groupBy(raster.owning_tile("longitude", "latitude", (-180.0, -85.0, 180.0, 85.0), 10.0).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


_CANDIDATES = "(SELECT DISTINCT 'h' || l_orderkey AS hex_id, l_suppkey AS poly_rid FROM lineitem)"


def _candidates(spark, sf_dir):
    return s.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("hex_id"), F.col("l_suppkey").alias("poly_rid")).distinct()


@query(f"SELECT hex_id, count(*) AS cnt FROM {_CANDIDATES} GROUP BY 1")
def hex_counts(spark, sf_dir):
    return cov.hex_counts(_candidates(spark, sf_dir))


@query(f"SELECT cnt = 1 AS single, count(*) AS n, count(*) FILTER (WHERE poly_rid % 2 = 0) AS even FROM (SELECT *, count(*) OVER (PARTITION BY hex_id) AS cnt FROM {_CANDIDATES}) GROUP BY 1")
def edge_split(spark, sf_dir):
    return cov.with_counts(_candidates(spark, sf_dir)).groupBy((F.col("cnt") == 1).alias("single")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("poly_rid") % 2 == 0).alias("even"))


@query(f"SELECT hex_id FROM {_CANDIDATES} WHERE poly_rid % 3 = 0 UNION SELECT hex_id FROM {_CANDIDATES} WHERE poly_rid % 5 = 0")
def needed_union(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.filter("poly_rid % 3 = 0").select("hex_id").unionByName(c.filter("poly_rid % 5 = 0").select("hex_id")).distinct()


# Rectangles: polygons from suppliers, square cells from parts, so that overlaps have a closed form. 100 polygons and 1600 cells a tile of 12 by 12, tiles upwards.
_BOXES = """polys AS (SELECT s_suppkey AS poly_rid, s_nationkey AS adm0, CAST(s_suppkey % 10 AS DOUBLE) AS x0, CAST(s_suppkey // 10 % 10 + 12 * ((s_suppkey - 1) // 100) AS DOUBLE) AS y0,
  CAST(s_suppkey % 10 + 1 + s_nationkey % 5 * 0.25 AS DOUBLE) AS x1, CAST(s_suppkey // 10 % 10 + 1.5 + 12 * ((s_suppkey - 1) // 100) AS DOUBLE) AS y1 FROM supplier),
squares AS (SELECT p_partkey AS hex, CAST(p_partkey % 40 AS DOUBLE) * CAST(0.3 AS DOUBLE) AS cx, CAST(p_partkey // 40 % 40 AS DOUBLE) * CAST(0.3 AS DOUBLE) + CAST(12 * ((p_partkey - 1) // 1600) AS DOUBLE) AS cy FROM part)"""
_OVERLAP = "greatest(0.0, least(x1, cx + 0.3) - greatest(x0, cx)) * greatest(0.0, least(y1, cy + 0.3) - greatest(y0, cy))"


#: Suppliers or parts that a task makes boxes of.
BOXES_PER_TASK = 50_000


def _boxes(spark, sf_dir, globe: bool = False):
    """All suppliers and parts: 100 polygons and 1600 cells a tile of 12 by 12; tiles follow to the north, on the `globe` eastwards first.

    Each tile holds as many whatever the table, so work grows with the rows. On the globe tiles are used again after 98.
    """
    k, q = F.col("s_suppkey"), F.col("p_partkey")

    def shift(tile):
        return (F.pmod(tile, F.lit(14)) * 12.0, F.pmod(F.floor(tile / 14), F.lit(7)) * 12.0) if globe else (F.lit(0.0), tile * 12.0)

    dx, dy = shift(F.greatest(F.lit(0), F.floor((k - 1) / 100)))
    p = indexing.spread(s.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), BOXES_PER_TASK).select(k.alias("poly_rid"), F.col("s_nationkey").cast("string").alias("adm0_iso"), (k % 10 + dx).alias("xmin"), (F.floor(k / 10) % 10 + dy).alias("ymin"), (k % 10 + 1 + F.col("s_nationkey") % 5 * 0.25 + dx).alias("xmax"), (F.floor(k / 10) % 10 + 1.5 + dy).alias("ymax"))
    dx, dy = shift(F.greatest(F.lit(0), F.floor((q - 1) / 1600)))
    c = indexing.spread(s.table(spark, sf_dir, "part").select("p_partkey"), BOXES_PER_TASK).select(q.cast("string").alias("hex_id"), (q % 40 * 0.3 + dx).alias("xmin"), (F.floor(q / 40) % 40 * 0.3 + dy).alias("ymin"))
    c = c.withColumn("xmax", F.col("xmin") + 0.3).withColumn("ymax", F.col("ymin") + 0.3)
    wkb = geometry.box_wkb("xmin", "ymin", "xmax", "ymax")
    return p.withColumn("geom_wkb", wkb), c.withColumn("cell_wkb", wkb)


def _box_candidates(p: DataFrame, c: DataFrame) -> DataFrame:
    """Cells and polygons that meet."""
    return spatial.box_pairs(c, p, "hex_id", "poly_rid")


@query(f"WITH {_BOXES} SELECT CAST(hex AS VARCHAR) AS hex_id, CAST(adm0 AS VARCHAR) AS adm0_iso, poly_rid AS adm2_id, {_r6(_OVERLAP + ' / 0.09')} AS pct FROM polys, squares WHERE {_OVERLAP} / 0.09 > 1e-9")
def coverage_exploded(spark, sf_dir):
    p, c = _boxes(spark, sf_dir)
    out = cov.exploded_coverage(_box_candidates(p, c), p.withColumn("adm2_id", F.col("poly_rid")), c, ["adm0_iso", "adm2_id"])
    return out.filter("pct > 1e-9").withColumn("pct", r6("pct"))


@query(f"WITH {_BOXES} SELECT CAST(hex AS VARCHAR) AS hex_id, poly_rid, {_r6(_OVERLAP)} AS area FROM polys, squares WHERE {_OVERLAP} > 1e-9")
def clip_area(spark, sf_dir):
    p, c = _boxes(spark, sf_dir)
    j = _box_candidates(p, c).join(p.select("poly_rid", "geom_wkb").hint("merge"), "poly_rid")
    j = j.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "hex_id").join(c.select("hex_id", "cell_wkb").hint("merge"), "hex_id")
    return j.select("hex_id", "poly_rid", geometry.overlap_area("geom_wkb", "cell_wkb").alias("area")).filter("area > 1e-9").withColumn("area", r6("area"))


_SHARED = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"WITH {_BOXES} SELECT a.poly_rid AS a, b.poly_rid AS b, {_r6(_SHARED)} AS area FROM polys a JOIN polys b ON a.adm0 = b.adm0 AND a.poly_rid < b.poly_rid WHERE {_SHARED} > 1e-9")
def overlay_area(spark, sf_dir):
    p, _ = _boxes(spark, sf_dir)
    pairs = spatial.box_pairs(p.withColumnRenamed("poly_rid", "a"), p.withColumnRenamed("poly_rid", "b"), "a", "b", on=["adm0_iso"]).filter("a < b")
    side = lambda n: p.select(F.col("poly_rid").alias(n), F.col("geom_wkb").alias(f"{n}_wkb"))
    out = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", geometry.shared_area("a_wkb", "b_wkb").alias("area"))
    return out.filter("area > 1e-9").withColumn("area", r6("area"))


# All corners lie on a lattice of 0.25 by 0.5, so a union is a number of its cells.
_CELLS = "cells AS (SELECT DISTINCT adm0, CAST(x0 * 4 AS BIGINT) + i AS x, CAST(y0 * 2 AS BIGINT) + j AS y FROM polys, range(8) a(i), range(3) b(j) WHERE i < (x1 - x0) * 4)"


@query(
    f"WITH {_BOXES}, {_CELLS}, shared AS (SELECT a.adm0, count(*) AS n FROM cells a JOIN cells b ON a.adm0 = b.adm0 AND a.x = b.x + 3 AND a.y = b.y + 1 GROUP BY 1) "
    "SELECT CAST(adm0 AS VARCHAR) AS adm0_iso, CAST(c.n AS DOUBLE) / 8 AS first, CAST(c.n AS DOUBLE) / 8 AS second, CAST(coalesce(shared.n, 0) AS DOUBLE) / 8 AS both FROM (SELECT adm0, count(*) AS n FROM cells GROUP BY 1) c LEFT JOIN shared USING (adm0)"
)
def union_area(spark, sf_dir):
    """The union of each country's polygons, that of the same ones moved aside, and what both cover."""
    p, _ = _boxes(spark, sf_dir)
    moved = p.withColumn("geom_wkb", geometry.box_wkb(F.col("xmin") + 0.75, F.col("ymin") + 0.5, F.col("xmax") + 0.75, F.col("ymax") + 0.5))
    out = union_areas(p, moved, by=["adm0_iso"])
    return out.select("adm0_iso", *[r6(c).alias(c) for c in ("first", "second", "both")])


_BOW = "p_partkey % 3 > 0"


@query(f"SELECT p_partkey, CASE WHEN {_BOW} THEN 2 ELSE 1 END AS n_parts, CAST((1 + p_partkey % 7) * (1 + p_size % 5) AS DOUBLE) / CASE WHEN {_BOW} THEN 2 ELSE 1 END AS area, NOT {_BOW} AS unchanged FROM part")
def repaired_area(spark, sf_dir):
    """Bow ties of two of three parts, boxes of the others, made valid."""
    x, y, w, h = F.col("p_partkey") % 40, F.floor(F.col("p_partkey") / 40) % 40, 1 + F.col("p_partkey") % 7, 1 + F.col("p_size") % 5
    at = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    corners = [at(x, y), F.when(F.expr(_BOW), at(x + w, y + h)).otherwise(at(x + w, y)), F.when(F.expr(_BOW), at(x + w, y)).otherwise(at(x + w, y + h)), at(x, y + h), at(x, y)]
    p = indexing.spread(s.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", geometry.wkt_to_wkb(F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corners), F.lit("))"))).alias("g"))
    p = p.withColumn("m", repaired("g"))
    return p.select("p_partkey", F.size(geometry.parts("m")).alias("n_parts"), r6(geometry.polygon_area("m")).alias("area"), (F.col("m") == F.col("g")).alias("unchanged"))


@query(f"WITH {_BOXES} SELECT CAST(hex AS VARCHAR) AS hex_id, poly_rid FROM polys, squares WHERE cx + 0.15 BETWEEN x0 AND x1 AND cy + 0.15 BETWEEN y0 AND y1")
def point_in_polygon(spark, sf_dir):
    p, c = _boxes(spark, sf_dir)
    j = _box_candidates(p, c).join(p.select("poly_rid", "geom_wkb").hint("merge"), "poly_rid")
    j = j.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "hex_id").join(c.select("hex_id", (F.col("xmin") + 0.15).alias("x"), (F.col("ymin") + 0.15).alias("y")).hint("merge"), "hex_id")
    return j.filter(geometry.covers_point("geom_wkb", "x", "y")).select("hex_id", "poly_rid")


@query(f"WITH {_BOXES}, country AS (SELECT adm0, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM polys GROUP BY 1) SELECT CAST(hex AS VARCHAR) AS hex_id FROM squares WHERE EXISTS (SELECT 1 FROM country WHERE adm0 <> 7 AND cx <= c AND cx + 0.3 >= a AND cy <= d AND cy + 0.3 >= b)")
def foreign_exists(spark, sf_dir):
    p, c = _boxes(spark, sf_dir)
    return cov.border_hexes(c.drop("cell_wkb"), c.select("hex_id").limit(0), cov.envelopes(p, "adm0_iso"), "7")


def _polar_sql() -> str:
    """Latitude of the south polar system, by the same series."""
    p = projections.projection_of(3031)
    at, n = math.radians(71), p.f / (2 - p.f)
    chi = f"(pi() / 2 - 2 * atan(sqrt(x * x + y * y) / {p.axis * p._m(at) / p._t(at)!r}::DOUBLE))"
    weights = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return f"degrees(-({chi}" + "".join(f" + {w!r}::DOUBLE * sin({2 * k} * {chi})" for k, w in enumerate(weights, 1)) + "))"


@query(
    f"SELECT event_id, {_r6('degrees(x / 6378137)')} AS web_lon, {_r6('degrees(pi() / 2 - 2 * atan(exp(-y / 6378137)))')} AS web_lat, {_r6('degrees(atan2(x, y))')} AS polar_lon, {_r6(_polar_sql())} AS polar_lat "
    "FROM (SELECT event_id, CAST(user_id % 3001 AS DOUBLE) * 1000 - 1500250 AS x, CAST(event_id % 2903 AS DOUBLE) * 1000 - 1450125 AS y FROM events)"
)
def projected_points(spark, sf_dir):
    """Places of all events in web Mercator and in a polar system, in degrees."""
    e = s.table(spark, sf_dir, "events")
    at = e.select("event_id", ((F.col("user_id") % 3001).cast("double") * 1000 - 1500250).alias("x"), ((F.col("event_id") % 2903).cast("double") * 1000 - 1450125).alias("y"))
    (web_lon, web_lat), (polar_lon, polar_lat) = (projections.lonlat("x", "y", code) for code in (3857, "EPSG:3031"))
    return at.select("event_id", *[r6(c).alias(n) for n, c in (("web_lon", web_lon), ("web_lat", web_lat), ("polar_lon", polar_lon), ("polar_lat", polar_lat))])


@query("SELECT l_suppkey, arg_max(l_partkey, struct_pack(a := area, k := -l_partkey)) AS l_partkey, max(area) AS area FROM (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS area FROM lineitem GROUP BY ALL) GROUP BY 1")
def maxoverlap_parent(spark, sf_dir):
    pairs = s.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("area"))
    return lookup.max_overlap(pairs, "l_suppkey", "l_partkey", "area")


@query(
    "SELECT chr(30) || '{\"type\":\"Feature\",\"tippecanoe\":{\"layer\":\"suppliers\",\"minzoom\":0,\"maxzoom\":9},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || (s_suppkey % 180) || '.5,' || (s_nationkey) || '.25]},\"properties\":{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\",\"note\":null}}' || chr(10) AS feature FROM supplier"
)
def feature_rows(spark, sf_dir):
    point = geometry.point_wkb(F.col("s_suppkey") % 180 + 0.5, F.col("s_nationkey") + 0.25)
    rows = s.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("note"), "s_acctbal", point.alias("geom"))
    return tiles.features([tiles.Layer("suppliers", rows, tiles.ZoomRange(0, 9), ("s_suppkey", "s_name", "note"))])


@query(f"{s.with_sql('coverage')} SELECT count(*) AS coverage_rows, count(*) FILTER (WHERE pct < 1.0) AS partial_pct_rows, count(DISTINCT hex_id) AS hexes FROM coverage")
def coverage_stats(spark, sf_dir):
    path = f"{work_folder(spark, 'coverage')}/exploded.parquet"
    stats = cov.write_exploded_coverage(lookup.conform_coverage(s.coverage(spark, sf_dir)), path)
    return spark.createDataFrame([stats], "coverage_rows long, partial_pct_rows long, hexes long")


@query()
def latlng_to_cell(spark, sf_dir):
    p = s.points(spark, sf_dir)
    return p.select("event_id", cells.to_string(hexgrid.point_to_cell(7)(F.col("longitude"), F.col("latitude"))).alias("hex_id"))


@query()
def points_to_cells(spark, sf_dir):
    return indexing.sample_to_cells(s.points(spark, sf_dir), 3, "max")


@query()
def pixels_to_cells(spark, sf_dir):
    p = _located(s.pixels(spark, sf_dir).filter("axis_index = 0"))
    return indexing.pixels_to_cells(p, 0.25, 0.25, resolution=4)


@query()
def polyfill(spark, sf_dir):
    p, _ = _boxes(spark, sf_dir, globe=True)
    return indexing.polygon_candidates(p, 4)


@query()
def coverage_of_cells(spark, sf_dir):
    p, _ = _boxes(spark, sf_dir, globe=True)
    cand = indexing.polygon_candidates(p, 4)
    return cov.exploded_coverage(cand, p, indexing.cell_geometries(cand), ["adm0_iso"])


@query()
def portfolio_points(spark, sf_dir):
    to_cell = hexgrid.point_to_cell(3)
    sites = s.points(spark, sf_dir).select(F.col("event_id").alias("asset_id"), "longitude", "latitude")
    cell = to_cell(F.col("longitude"), F.col("latitude"))
    c = s.points(spark, sf_dir).select(cell.alias("cell_index")).distinct()
    k = F.col("cell_index")
    c = c.select(k, F.lit("s").alias("source_id"), F.lit(None).cast("binary").alias("source_geometry"), F.lit("flood").alias("hazard_name"), F.lit(2050).alias("horizon"), F.lit("ssp585").alias("pathway"), F.lit("fitted").alias("curve_kind"), F.lit("gumbel_r").alias("curve_type"), F.lit(None).cast("double").alias("curve_shape"), F.pmod(F.shiftright(k, 36), F.lit(40)).cast("double").alias("curve_location"), F.lit(2.0).alias("curve_scale"), F.lit(None).cast("double").alias("curve_atom_probability"), F.lit(None).cast("double").alias("curve_atom_location"))
    return _rounded(Evaluation(c, Assets(sites), cell_of=to_cell).return_periods(PERIODS).evaluate(skewnorm=False))


from terragrist.plans import stored  # noqa: E402  registers the queries over written stores

__all__ = ["FAMILIES", "ORACLE_SQL", "QUERIES", "Window", "stored"]
