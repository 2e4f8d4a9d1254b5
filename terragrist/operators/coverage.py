"""Exact coverage of cells by polygons.

A candidate (cell, polygon) whose cell no edge of the polygon comes near has share 1 or 0 by one corner; only cells at the edge are
clipped, whatever the number of their candidates. The share is computed once, in one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terragrist.functions.cells import coverage_parent_resolution, parent_of_string
from terragrist.functions.geometry import cell_share
from terragrist.operators.indexing import cell_geometries
from terragrist.operators.spatial import box_pairs
from terragrist.sources.publish import publish, work_folder

#: A polygon contains a cell if it covers all of its area but for rounding.
TOUCH = 1e-9


def hex_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("hex_id").agg(F.count(F.lit(1)).alias("cnt"))


def with_counts(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("hex_id")))


def shares(candidates: DataFrame, polys: DataFrame, cells: DataFrame, rid: str = "poly_rid", geom: str = "geom_wkb", path: Sequence[str] = ()) -> DataFrame:
    """(hex_id, poly_rid, cnt, pct): candidates with their share of the cell, not clamped, zero shares dropped; with a `path`, also its columns of the polygon, as a struct `told`, which so need no join of their own."""
    # Dealt by cell into a fixed number of tasks, as pairs are small and their clipping is not; the count and the cells' join then need no shuffle of their own.
    dealt = candidates.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hex_id")
    # Geometries are merged, as Spark's estimates of them, from columns of numbers in small files, would have them broadcast in any number.
    told = [F.struct(*path).alias("told")] if path else []
    shapes = polys.select(F.col(rid).alias("poly_rid"), F.col(geom).alias("g"), *told)
    j = with_counts(dealt).join(cells.select("hex_id", "cell_wkb").hint("merge"), "hex_id").join(shapes.hint("merge"), "poly_rid")
    return j.select("hex_id", "poly_rid", "cnt", cell_share("g", "cell_wkb").alias("pct"), *(["told"] if path else [])).filter("pct > 0")


def _told(path: Sequence[str]) -> list[str]:
    return ["told.*"] if path else []


def edge_hexes(candidates: DataFrame, polys: DataFrame, cells: DataFrame) -> DataFrame:
    """Single-candidate cells that their polygon does not contain."""
    single = with_counts(candidates).filter("cnt = 1").drop("cnt")
    return shares(single, polys, cells).filter(F.col("pct") < 1 - TOUCH).select("hex_id")


def exploded_coverage(candidates: DataFrame, polys: DataFrame, cells: DataFrame, path: list[str], *, resolution: int | None = None, parents: DataFrame | None = None) -> DataFrame:
    """(hex_id, path..., pct) of every candidate with a share.

    With `parents` (hex_id, cell_wkb of the parent cells) and a resolution of 6 or more, single-candidate cells whose parent
    lies in their polygon get share 1 from one containment test a (parent, polygon), without a geometry of their own. Children
    are not exactly nested in parents, so this is an approximation at polygon borders, as in the hierarchical mode that it follows.
    """
    coarse = coverage_parent_resolution(resolution) if resolution is not None and parents is not None else None
    if coarse is None:
        return shares(candidates, polys, cells, path=path).select("hex_id", *_told(path), "pct")
    c = with_counts(candidates).withColumn("parent", F.when(F.col("cnt") == 1, parent_of_string(F.col("hex_id"), coarse)))
    pairs = c.filter("cnt = 1").select(F.col("parent").alias("hex_id"), "poly_rid").distinct()
    inside = shares(pairs, polys, parents).filter(F.col("pct") >= 1 - TOUCH).select(F.col("hex_id").alias("parent"), "poly_rid", F.lit(True).alias("inside"))
    c = c.join(inside, ["parent", "poly_rid"], "left")
    whole = c.filter("inside").select("hex_id", "poly_rid", F.lit(1.0).alias("pct"))
    s = shares(c.filter("inside is null").select("hex_id", "poly_rid"), polys, cells).select("hex_id", "poly_rid", "pct").unionByName(whole)
    return s.join(polys.select("poly_rid", *path).hint("merge"), "poly_rid").select("hex_id", *path, "pct")


def _row_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("coverage_rows"), F.count_if(F.col("pct") < 1.0).alias("partial_pct_rows")]


def coverage_stats(coverage: DataFrame) -> DataFrame:
    return coverage.agg(*_row_counts(), F.countDistinct("hex_id").alias("hexes"))


def write_exploded_coverage(coverage: DataFrame, path: str, *, mode: str = "errorifexists") -> dict[str, int]:
    """Writes exploded coverage whole or not at all and gives its statistics, read from what was written."""
    written = publish(coverage, path, mode=mode)
    return coverage_stats(written).first().asDict()


def write_coverage(
    candidates: DataFrame, polys: DataFrame, out: str, *, path: list[str], resolution: int, parent_resolution: int | None = None, cache: DataFrame | None = None, mode: str = "errorifexists"
) -> dict[str, int | str]:
    """Writes (hex_id, path.., pct) of every candidate with a share, whole or not at all, and gives counts of what was done.

    From resolution 6 on by parents: a cell with one candidate whose parent (two resolutions coarser, or `parent_resolution`) lies in its polygon has share 1 and gets no geometry. Below, all
    cells are measured. Geometries come from `cache` (hex_id, cell_wkb) where it has them. Candidates must be distinct; cells or polygons that are null are left out.

    Counts: `single` and `competing` cells, `competing_ops` pairs of the latter, `edge_singles`, cells that their only polygon does not contain, `needed_hexes` (these and competing ones), `coverage_rows`,
    `partial_pct_rows`; by parents also `parent_touch` pairs, `parent_geoms`, `interior_parents` and `boundary_parents` pairs, `boundary_children`.
    """
    if parent_resolution is None:
        parent_resolution = coverage_parent_resolution(resolution)
    if not 0 <= resolution <= 15 or parent_resolution is not None and not 0 <= parent_resolution < resolution:
        raise ValueError("resolutions must lie within 0 and 15, that of parents below that of cells")
    folder = work_folder(candidates.sparkSession, "coverage")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    known = candidates.select("hex_id", "poly_rid").filter("hex_id is not null and poly_rid is not null").join(polys.select("poly_rid").hint("merge"), "poly_rid", "left_semi")
    c = kept(with_counts(known), "counted")
    singles, competing = c.filter("cnt = 1"), c.filter("cnt > 1").select("hex_id", "poly_rid")
    many = F.col("cnt") > 1
    # A cell with cnt candidates is cnt rows, so cells are counted without making them distinct.
    n = c.groupBy("cnt").agg(F.count(F.lit(1)).alias("n")).agg(*[F.coalesce(F.sum(F.when(of, x)), F.lit(0)).cast("long").alias(k) for k, of, x in (("single", ~many, F.col("n")), ("competing_ops", many, F.col("n")), ("competing", many, F.expr("n div cnt")))]).first().asDict()
    stats: dict[str, int | str] = {"mode": "flat" if parent_resolution is None else "hierarchical", **n}
    whole = None
    if parent_resolution is not None:
        singles = singles.withColumn("parent", parent_of_string(F.col("hex_id"), parent_resolution))
        touch = kept(singles.select("parent", "poly_rid").distinct(), "touch")
        parents = cell_geometries(touch, "parent").withColumnRenamed("hex_id", "parent")
        inside = cell_share("g", "cell_wkb") >= 1 - TOUCH
        classes = touch.join(parents, "parent").join(polys.select("poly_rid", F.col("geom_wkb").alias("g")), "poly_rid").select("parent", "poly_rid", F.coalesce(inside, F.lit(False)).alias("interior"))
        classes = kept(classes, "classes")
        stats |= classes.agg(F.count(F.lit(1)).alias("parent_touch"), F.count_distinct("parent").alias("parent_geoms"), F.count_if("interior").alias("interior_parents"), F.count_if(~F.col("interior")).alias("boundary_parents")).first().asDict()
        marked = kept(singles.join(classes, ["parent", "poly_rid"]).select("hex_id", "poly_rid", "interior"), "marked")
        whole, singles = marked.filter("interior").select("hex_id", "poly_rid", F.lit(1.0).alias("pct")), marked.filter("not interior")
        stats["boundary_children"] = singles.count()
    measured = c.select("hex_id", "poly_rid") if whole is None else singles.select("hex_id", "poly_rid").unionByName(competing)
    contains = (F.col("cnt") == 1) & (F.col("pct") >= 1 - TOUCH)
    found = kept(shares(measured, polys, cell_geometries(measured, cache=cache), path=path).withColumn("pct", F.when(contains, 1.0).otherwise(F.col("pct"))), "shares")
    stats["edge_singles"] = (stats["single"] if whole is None else stats["boundary_children"]) - found.filter(contains).count()
    stats["needed_hexes"] = stats["edge_singles"] + stats["competing"]
    rows = found.select("hex_id", *_told(path), "pct")
    if whole is not None:
        rows = rows.unionByName(whole.join(polys.select("poly_rid", *path).hint("merge"), "poly_rid").select("hex_id", *path, "pct"))
    return stats | publish(rows, out, mode=mode).agg(*_row_counts()).first().asDict()


def envelopes(polys: DataFrame, group: str) -> DataFrame:
    """Bounds of each group from bounds columns."""
    return polys.groupBy(group).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def border_hexes(cells: DataFrame, edges: DataFrame, countries: DataFrame, country: str) -> DataFrame:
    """Edge cells, and cells whose bounds meet the bounds of another country, once each. cells and countries carry bounds columns.

    A spatial join, for any number of countries; a cell that many countries meet is one row a country before it is made one.
    """
    others = countries.filter(F.col("adm0_iso") != country)
    near = box_pairs(cells, others, "hex_id", "adm0_iso").select("hex_id")
    return near.unionByName(edges.select("hex_id")).distinct()
