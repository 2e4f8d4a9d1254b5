"""Administrative lookups from exploded coverage: best path, rollups, candidate counts, nested list, catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terragrist.functions.cells import parent_of_string
from terragrist.sources.publish import publish, work_folder

PATH = ["adm0_iso", "adm1_id", "adm1_name", "adm2_id", "adm2_name"]
#: Rows of coverage in a task that sorts them by cell, and of a lookup in a task that sorts and writes them.
ROWS_PER_TASK = 500_000


def conform_coverage(df: DataFrame) -> DataFrame:
    """Coverage with all path columns (absent ones null), positive shares only, shares clamped to 0..1."""
    path = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in PATH]
    pct = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pct").cast("double")))
    return df.filter("pct > 0").select(F.col("hex_id").cast("string").alias("hex_id"), *path, pct.alias("pct"))


def best_paths(coverage: DataFrame) -> DataFrame:
    """The row of largest share of each cell; ties by path, nulls last."""
    order = [F.desc_nulls_last("pct"), *(F.asc_nulls_last(c) for c in PATH)]
    w = Window.partitionBy("hex_id").orderBy(*order)
    best = coverage.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return best.select("hex_id", *[F.col(c).alias(f"best_{c.replace('_iso', '')}") for c in PATH], F.col("pct").alias("best_pct"))


def rollup_adm0(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("hex_id", "adm0_iso").agg(F.least(F.lit(1.0), F.sum("pct")).alias("adm0_pct"))


def rollup_adm1(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("hex_id", "adm0_iso", "adm1_id", "adm1_name").agg(F.least(F.lit(1.0), F.sum("pct")).alias("adm1_pct"))


def candidate_counts(coverage: DataFrame) -> DataFrame:
    adm1 = F.struct("adm0_iso", F.coalesce("adm1_id", "adm1_name"))
    return coverage.groupBy("hex_id").agg(
        F.countDistinct("adm0_iso").cast("int").alias("adm0_count"), F.countDistinct(adm1).cast("int").alias("adm1_count"), F.count(F.lit(1)).cast("int").alias("adm2_count")
    )


def _path_order(a: Column, b: Column) -> Column:
    out = F.when(a["pct"] > b["pct"], -1).when(a["pct"] < b["pct"], 1)
    for c in ("adm0_iso", "adm1_id", "adm2_id"):
        x, y = a[c], b[c]
        out = out.when(x.isNull() & y.isNotNull(), 1).when(x.isNotNull() & y.isNull(), -1).when(x < y, -1).when(x > y, 1)
    return out.otherwise(0)


def nested_coverage(coverage: DataFrame) -> DataFrame:
    """(hex_id, coverage): paths by share, largest first; then by adm0, adm1 and adm2 id, nulls last."""

    return coverage.groupBy("hex_id").agg(F.array_sort(F.collect_list(F.struct(*PATH, "pct")), _path_order).alias("coverage"))


def lookup_contract(exploded: DataFrame, resolution: int, *, include_coverage: bool = True, interior_threshold: float = 0.999999) -> DataFrame:
    """One row per cell: best path, parents at resolutions 3 to 7 (null if finer than the cell), rolled-up shares and counts of
    the best path, interior flags, and optionally all paths. Cells of a best path without adm0 have no rollup and drop out.

    The coverage is shuffled by cell once; shares, counts, list and best path are windows within a cell, which has few rows. The rows are counted first, so
    that tasks are as many as their number asks for (`ROWS_PER_TASK`) and what a task sorts does not grow with the table.
    """
    c = conform_coverage(exploded)
    c = c.repartition(max(-(-c.count() // ROWS_PER_TASK), int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "hex_id")
    cell = Window.partitionBy("hex_id")
    capped = lambda *by: F.least(F.lit(1.0), F.sum("pct").over(Window.partitionBy("hex_id", *by)))
    distinct = lambda x: F.size(F.collect_set(x).over(cell))
    c = c.withColumn("adm1_pct", capped("adm0_iso", "adm1_id", "adm1_name")).withColumn("adm0_pct", capped("adm0_iso"))
    c = c.withColumn("adm0_count", distinct("adm0_iso")).withColumn("adm1_count", distinct(F.struct("adm0_iso", F.coalesce("adm1_id", "adm1_name"))))
    c = c.withColumn("adm2_count", F.count(F.lit(1)).over(cell).cast("int"))
    if include_coverage:
        c = c.withColumn("coverage", F.array_sort(F.collect_list(F.struct(*PATH, "pct")).over(cell), _path_order))
    best = Window.partitionBy("hex_id").orderBy(F.desc_nulls_last("pct"), *(F.asc_nulls_last(x) for x in PATH))
    c = c.withColumn("r", F.row_number().over(best)).filter("r = 1 and adm0_iso is not null")
    interior = lambda n, share: (F.col(n) == 1) & (F.col(share) >= interior_threshold)
    parents = [(parent_of_string(F.col("hex_id"), r) if r <= resolution else F.lit(None).cast("string")).alias(f"h3_r{r}") for r in range(3, 8)]
    cols = ["hex_id", *parents, *[F.col(p).alias(f"best_{p.replace('_iso', '')}") for p in PATH], F.col("pct").alias("best_pct"), "adm0_pct", "adm1_pct", "adm0_count", "adm1_count", "adm2_count"]
    cols += [interior("adm0_count", "adm0_pct").alias("is_adm0_interior"), interior("adm1_count", "adm1_pct").alias("is_adm1_interior"), interior("adm2_count", "pct").alias("is_adm2_interior")]
    return c.select(*cols, *(["coverage"] if include_coverage else []))


def write_lookup(lookup: DataFrame, path: str, *, sort: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Writes a lookup whole or not at all; sorted by parent cell and cell if asked, which narrows the key ranges of files.

    What is to be sorted is written to the shared folder first, as choosing ranges would do its windows a second time. Its rows are counted there, so that ranges
    are as many as their number asks for (`ROWS_PER_TASK`): by bytes of the shuffle, which packs ids well, a task would get many times what it can hold.
    """
    if sort:
        on_the_way = f"{work_folder(lookup.sparkSession, 'unsorted')}/lookup.parquet"
        lookup.write.parquet(on_the_way)
        lookup = lookup.sparkSession.read.schema(lookup.schema).parquet(on_the_way)
        ranges = -(-max(1, lookup.count()) // ROWS_PER_TASK)
        lookup = lookup.repartitionByRange(ranges, "h3_r3", "hex_id").sortWithinPartitions("h3_r3", "hex_id")
    return publish(lookup, path, mode=mode)


def write_partitioned(lookup: DataFrame, path: str, resolution: int, partition_resolution: int = 0, *, rows_per_file: int = 1_000_000, mode: str = "errorifexists") -> None:
    """Hive directories by parent cell, whole or not at all.

    Rows are dealt by ranges of parent and cell, as many as their number asks for: a parent with many rows is several sorted ranges and so several tasks and
    files, and parents with few share a task. No file has more than `rows_per_file` rows.
    """
    if not 0 <= partition_resolution < resolution <= 15:
        raise ValueError("0 <= partition_resolution < resolution <= 15 must hold")
    name = f"h3_r{partition_resolution}"
    if name not in lookup.columns:
        lookup = lookup.withColumn(name, parent_of_string(F.col("hex_id"), partition_resolution))
    ranges = -(-max(1, lookup.count()) // rows_per_file)
    dealt = lookup.repartitionByRange(ranges, name, "hex_id").sortWithinPartitions(name, "hex_id")
    publish(dealt, path, mode=mode, save=lambda writer, to: writer.option("maxRecordsPerFile", rows_per_file).partitionBy(name).parquet(to))


def max_overlap(pairs: DataFrame, key: str, value: str, area: str) -> DataFrame:
    """The value with the largest area of each key; ties to the smaller value, null values and areas do not compete."""
    w = Window.partitionBy(key).orderBy(F.desc(area), F.asc(value))
    live = pairs.filter(F.col(value).isNotNull() & F.col(area).isNotNull())
    chosen = live.withColumn("r", F.row_number().over(w)).filter("r = 1").select(key, value, area)
    return pairs.select(key).distinct().join(chosen, key, "left")


@dataclass(frozen=True)
class LookupCatalog:
    """Where the tables of a lookup stand, and the reads of them."""

    root: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "root", self.root.rstrip("/"))

    def lookup_uri(self, resolution: int) -> str:
        return f"{self.root}/r{resolution}.parquet"

    def exploded_uri(self, resolution: int) -> str:
        return f"{self.root}/r{resolution}_exploded.parquet"

    def partitioned_root(self, resolution: int) -> str:
        return f"{self.root}/r{resolution}"

    def partitioned_uri(self, resolution: int, partition_resolution: int, parent: str | None = None) -> str:
        return f"{self.partitioned_root(resolution)}/h3_r{partition_resolution}={parent or '*'}/*.parquet"

    def version_uri(self) -> str:
        return f"{self.root}/.version"

    def assignments(self, spark: SparkSession, resolution: int = 7, partition_resolution: int | None = None, parent: str | None = None) -> DataFrame:
        """The lookup of a resolution; with a partition resolution its partitioned form, of one parent only the directory of that parent."""
        if partition_resolution is None:
            return spark.read.parquet(self.lookup_uri(resolution))
        df = spark.read.parquet(self.partitioned_root(resolution))
        return df if parent is None else df.filter(F.col(f"h3_r{partition_resolution}") == parent)


def country_cells(table: DataFrame, iso: str, *, field: str = "adm0_iso") -> DataFrame:
    """Sorted distinct cells of a country: of a lookup those whose best or any path is in it, of exploded coverage those with a share."""
    iso = iso.upper()
    if "coverage" in table.columns:
        hit = (F.col("best_adm0") == iso) | F.exists("coverage", lambda c: c[field] == iso)
    else:
        hit = (F.col(field) == iso) & (F.col("pct") > 0)
    return table.filter(hit).select("hex_id").distinct().orderBy("hex_id")
