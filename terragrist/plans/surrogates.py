"""The driver's tables seen as assets, curves, coverage, raster pixels, knots and points: once as DataFrames, once as SQL."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrist.sources.publish import work_folder, write_bytes
from terragrist.sources.raster import RasterMetadata, ZarrRaster

FAMILY_BY_KEY = ("gumbel_r", "gumbel_l", "genextreme", "weibull_min", "weibull_max", "genpareto")
SHAPE_BY_KEY = (None, None, 0.1, 1.5, 1.5, 0.1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_custkey").alias("cell_index"), F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").alias("baseline"))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    family, shape = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (f, s) in enumerate(zip(FAMILY_BY_KEY, SHAPE_BY_KEY)):
        family = F.when(k % 6 == i, f).otherwise(family)
        shape = F.when(k % 6 == i, F.lit(s).cast("double")).otherwise(shape)
    hurdle = k % 5 == 0
    base = p.select(
        k.cast("long").alias("cell_index"), F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.lit(None).cast("binary").alias("source_geometry"), F.lit("flood").alias("hazard_name"),
        F.explode(F.array(F.lit(2030), F.lit(2050))).alias("horizon"), "p_partkey", "p_size",
    )
    base = base.withColumn("pathway", F.explode(F.array(F.lit("ssp245"), F.lit("ssp585"))))
    return base.select(
        "cell_index", "source_id", "source_geometry", "hazard_name", "horizon", "pathway", F.when(hurdle, "hurdle").otherwise("fitted").alias("curve_kind"), family.alias("curve_type"), shape.alias("curve_shape"),
        F.col("p_size").cast("double").alias("curve_location"), (1 + (k % 7) * 0.25).cast("double").alias("curve_scale"), F.when(hurdle, 0.5).alias("curve_atom_probability"), F.when(hurdle, 0.0).alias("curve_atom_location"),
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("hex_id"), F.col("l_returnflag").alias("adm0_iso"), F.nullif(F.col("l_linestatus"), F.lit("O")).alias("adm1_id"),
        F.col("l_linestatus").alias("adm1_name"), F.col("l_suppkey").cast("string").alias("adm2_id"), F.lit(None).cast("string").alias("adm2_name"), (F.col("l_quantity") / 50).alias("pct"),
    )


def hex_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage with ids in the cell layout, at resolution 8: order keys as base cell and digits."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lower(F.hex(cell_of_key(F.col("l_orderkey")))).alias("hex_id"), F.col("l_returnflag").alias("adm0_iso"), F.nullif(F.col("l_linestatus"), F.lit("O")).alias("adm1_id"),
        F.col("l_linestatus").alias("adm1_name"), F.col("l_suppkey").cast("string").alias("adm2_id"), F.lit(None).cast("string").alias("adm2_name"), (F.col("l_quantity") / 50).alias("pct"),
    )


def cell_of_key(key):
    """A resolution-8 id: mode 1, base cell key % 122, digits from the octal places of key // 122 (7 becomes 6)."""
    c = F.lit((1 << 59) | (8 << 52) | ((1 << 21) - 1)).bitwiseOR(F.shiftleft((key % 122).cast("long"), 45))
    k = F.floor(key / 122).cast("long")
    for d in range(8):
        c = c.bitwiseOR(F.shiftleft(F.least(F.lit(6).cast("long"), F.shiftright(k, 3 * d).bitwiseAND(F.lit(7))), 3 * (15 - (8 - d))))
    return c


CELL_SQL = "((1::BIGINT << 59) | (8::BIGINT << 52) | ((1::BIGINT << 21) - 1) | ((l_orderkey % 122)::BIGINT << 45)" + "".join(f" | (least(6, ((l_orderkey // 122) >> {3 * d}) & 7)::BIGINT << {3 * (15 - (8 - d))})" for d in range(8)) + ")"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 97).alias("row"), (F.col("l_partkey") % 89).alias("col"), (F.col("l_linenumber") - 1).cast("int").alias("axis_index")).agg(F.max("l_extendedprice").alias("value"))


SHAPE, CHUNKS, PERIODS = (7, 97, 89), (3, 25, 30), [2, 5, 10, 25, 50, 100, 1000]


def _array(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The pixels as an array; of 7 x 97 x 89 values whatever the table."""
    out, t = np.full(SHAPE, np.nan), pixels(spark, sf_dir).toArrow()
    out[tuple(t[x].to_numpy().astype(int) for x in ("axis_index", "row", "col"))] = t["value"].to_numpy()
    return out


def stored_raster(spark: SparkSession, sf_dir: str) -> ZarrRaster:
    """The pixels as a chunked array in the shared folder; chunks without any value are left out."""
    folder, data = f"{work_folder(spark, 'array')}/depth", _array(spark, sf_dir)
    info = {"zarr_format": 2, "shape": SHAPE, "chunks": CHUNKS, "dtype": "<f8", "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN", "order": "C", "filters": None}
    about = {"transform_mat3x3": [0.25, 0, -10, 0, -0.25, 50, 0, 0, 1], "index_values": PERIODS, "index_name": "return period (years)"}
    for name, said in ((".zarray", info), (".zattrs", about)):
        write_bytes(spark, f"{folder}/{name}", json.dumps(said).encode())
    for at in np.ndindex(*(-(-n // c) for n, c in zip(SHAPE, CHUNKS))):
        block = np.full(CHUNKS, np.nan)
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, CHUNKS))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        if np.isfinite(part).any():
            write_bytes(spark, f"{folder}/{'.'.join(map(str, at))}", zlib.compress(block.astype("<f8").tobytes(), 1))
    return ZarrRaster.open(spark, folder, RasterMetadata("flood", "depth", "ssp585", 2050, "metres", "array/depth"))


def stored_geotiff(spark: SparkSession, sf_dir: str) -> str:
    """The first layer of the pixels as a band of deflated strips of 16 rows, with a nodata value."""
    data = np.nan_to_num(_array(spark, sf_dir)[0], nan=-9999.0).astype("<f4")
    strips = [zlib.compress(data[i : i + 16].tobytes()) for i in range(0, len(data), 16)]
    floats = {33550: struct.pack("<3d", 0.25, 0.25, 0), 33922: struct.pack("<6d", 0, 0, 0, -10, 50, 0)}
    at, body, where = 8, b"", []
    for x in strips:
        where.append(at)
        body, at = body + x, at + len(x)
    extra = {}
    for tag, x in {273: struct.pack(f"<{len(strips)}I", *where), 279: struct.pack(f"<{len(strips)}I", *map(len, strips)), 42113: b"-9999\0\0\0", **floats}.items():
        extra[tag], body, at = at, body + x, at + len(x)
    one = {256: (4, data.shape[1]), 257: (4, data.shape[0]), 258: (3, 32), 259: (3, 8), 262: (3, 1), 277: (3, 1), 278: (4, 16), 339: (3, 3)}
    many = {273: (4, len(strips)), 279: (4, len(strips)), 33550: (12, 3), 33922: (12, 6), 42113: (2, 8)}
    tags = b""
    for tag in sorted(one | many):
        kind, n, value = (one[tag][0], 1, one[tag][1]) if tag in one else (*many[tag], extra[tag])
        tags += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    path = f"{work_folder(spark, 'band')}/depth.tif"
    write_bytes(spark, path, b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(one | many)) + tags + struct.pack("<I", 0))
    return path


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, period, probability, value), whole cents, so that sums do not depend on their order by much."""
    li = table(spark, sf_dir, "lineitem")
    periods = F.array(*[F.lit(float(x)) for x in (2, 5, 10, 25, 50, 100, 1000)])
    k = li.groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_extendedprice").alias("value")).withColumn("period", F.get(periods, F.col("l_linenumber") - 1))
    return k.filter("period is not null").select("l_suppkey", "period", (1 - 1 / F.col("period")).alias("probability"), (F.floor(F.col("value") + F.col("period") * 40)).cast("double").alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", ((F.col("user_id") % 3600) / 10 - 180).alias("longitude"), ((F.col("event_id") % 1700) / 10 - 85).alias("latitude"), "value")


_FAMILY = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAMILY_BY_KEY)) + " END"
_SHAPE = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN CAST({s} AS DOUBLE)" for i, s in enumerate(SHAPE_BY_KEY) if s is not None) + " END"

SQL = {
    "assets": "SELECT c_custkey AS asset_id, c_custkey AS cell_index, c_mktsegment AS sector, c_acctbal AS baseline FROM customer",
    "curves": f"""SELECT CAST(p_partkey AS BIGINT) AS cell_index, 's' || p_partkey AS source_id, 'flood' AS hazard_name, horizon, pathway,
  CASE WHEN p_partkey % 5 = 0 THEN 'hurdle' ELSE 'fitted' END AS curve_kind, {_FAMILY} AS curve_type, {_SHAPE} AS curve_shape,
  CAST(p_size AS DOUBLE) AS curve_location, CAST(1 + (p_partkey % 7) * 0.25 AS DOUBLE) AS curve_scale,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(0.5 AS DOUBLE) END AS curve_atom_probability, CASE WHEN p_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) END AS curve_atom_location
  FROM part, (VALUES (2030), (2050)) h(horizon), (VALUES ('ssp245'), ('ssp585')) w(pathway)""",
    "coverage": "SELECT 'h' || l_orderkey AS hex_id, l_returnflag AS adm0_iso, nullif(l_linestatus, 'O') AS adm1_id, l_linestatus AS adm1_name, CAST(l_suppkey AS VARCHAR) AS adm2_id, CAST(NULL AS VARCHAR) AS adm2_name, CAST(l_quantity AS DOUBLE) / 50 AS pct FROM lineitem",
    "hexes": f"SELECT lower(printf('%x', {CELL_SQL})) AS hex_id, l_returnflag AS adm0_iso, nullif(l_linestatus, 'O') AS adm1_id, l_linestatus AS adm1_name, CAST(l_suppkey AS VARCHAR) AS adm2_id, CAST(NULL AS VARCHAR) AS adm2_name, CAST(l_quantity AS DOUBLE) / 50 AS pct FROM lineitem",
    "pixels": 'SELECT l_orderkey % 97 AS "row", l_partkey % 89 AS col, CAST(l_linenumber - 1 AS INTEGER) AS axis_index, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3',
    "knots": """SELECT l_suppkey, period, 1 - 1 / period AS probability, floor(v + period * 40) AS value FROM (SELECT l_suppkey, l_linenumber, avg(l_extendedprice) AS v,
  CAST([2, 5, 10, 25, 50, 100, 1000][l_linenumber] AS DOUBLE) AS period FROM lineitem GROUP BY 1, 2) WHERE period IS NOT NULL""",
    "points": "SELECT event_id, (user_id % 3600) / 10 - 180 AS longitude, (event_id % 1700) / 10 - 85 AS latitude, value FROM events",
}


def with_sql(*names: str) -> str:
    """WITH clauses of surrogate tables, to go before a query."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
