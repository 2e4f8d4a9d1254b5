"""Second-level districts with the first-level district that holds most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrist.functions.geometry import extent, shared_area
from terragrist.functions.repair import repaired
from terragrist.operators.spatial import box_pairs


def enrich_districts(adm2: DataFrame, adm1: DataFrame, *, group: str = "adm0_iso", geometry: str = "geom_wkb") -> DataFrame:
    """`adm2` (adm2_rid, group, geometry, ...) with adm1_id and adm1_name of the district of its group with the largest shared area.

    Districts whose bounds meet are found by a spatial join within the group, so a group may have any number of them; geometries are
    fetched for the pairs found, and the shared area is computed once for each. Districts without a match keep null names. Id and name come from the district with the largest area (equal areas: smaller id, then name);
    where that one has no id or no name, from the next one that has. Polygons that cross themselves are measured by the even-odd rule.
    """
    box = lambda d, k: d.withColumn("__e", extent(geometry)).select(k, group, F.col("__e.xmin").alias("xmin"), F.col("__e.ymin").alias("ymin"), F.col("__e.xmax").alias("xmax"), F.col("__e.ymax").alias("ymax"))
    one = adm1.select("adm1_id", "adm1_name", group, geometry).withColumn("__one", F.xxhash64("adm1_id", "adm1_name", group, geometry)).dropDuplicates(["__one"])
    found = box_pairs(box(adm2, "adm2_rid"), box(one, "__one"), "adm2_rid", "__one", on=[group])
    pairs = found.join(adm2.select("adm2_rid", repaired(geometry).alias("__a")), "adm2_rid").join(one.select("__one", "adm1_id", "adm1_name", repaired(geometry).alias("__b")), "__one")
    pairs = pairs.select("adm2_rid", "adm1_id", "adm1_name", shared_area("__a", "__b").alias("area")).filter("area > 0")
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col("area")).alias("a"), "adm1_id", "adm1_name")))[c].alias(c)
    return adm2.join(pairs.groupBy("adm2_rid").agg(best("adm1_id"), best("adm1_name")), "adm2_rid", "left")
