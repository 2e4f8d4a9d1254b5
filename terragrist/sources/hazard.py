"""The canonical hazard store: validated, sorted Parquet with metadata, and pushed-down reads."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terragrist.schema import COLUMNS, HAZARD_SCHEMA, METADATA_KEY, ROW_KEY, HazardMetadata, checked, conform, duplicate_keys, invalid_rows, row_fault, validate
from terragrist.sources.publish import bucketed, publish
from terragrist.sources.publish import read_bucketed as _read_bucketed

#: In the first column's field of stores whose rows and keys were checked when they were written.
CHECKED_KEY = "terragrist.checked"
CODECS = ("uncompressed", "snappy", "gzip", "zstd", "lz4_raw")


@dataclass(frozen=True)
class HazardQuery:
    """A conjunction of equalities."""

    hazard_name: str
    horizon: int | None = None
    pathway: str | None = None
    cell_index: int | None = None

    def __post_init__(self) -> None:
        if not self.hazard_name:
            raise ValueError("hazard_name must not be empty")
        if self.cell_index is not None and not 0 <= self.cell_index < 1 << 64:
            raise ValueError("cell_index must be an unsigned 64-bit number")


def sort_rows(df: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by the row key, so that files and row groups have narrow key ranges."""
    return df.repartitionByRange(*ROW_KEY).sortWithinPartitions(*ROW_KEY)


def _write_checked(rows: DataFrame, path: str, metadata: HazardMetadata, compression: str, mode: str, save=None) -> None:
    """Writes rows that lie together by key. The rules of rows and keys are counted while the rows are written; if any is broken nothing is published."""
    if compression not in CODECS:
        raise ValueError(f"compression must be one of {CODECS}")
    seen = Observation("rules")
    again = F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy(*ROW_KEY))  # rows lie by key already, so this sorts and does not shuffle
    out = rows.withColumn("__again", again > 1).withColumn("__fault", row_fault().isNotNull())
    out = out.observe(seen, F.count_if("__fault").alias("invalid"), F.count_if("__again").alias("repeated"))
    first = F.col(COLUMNS[0]).alias(COLUMNS[0], metadata={METADATA_KEY: metadata.to_json(), CHECKED_KEY: "rows and keys"})

    def accept() -> None:
        found = seen.get
        if found["invalid"]:
            raise ValueError(f"invalid hazard rows ({found['invalid']}): {[r.asDict() for r in invalid_rows(rows).select(*ROW_KEY, 'fault').limit(5).collect()]}")
        if found["repeated"]:
            raise ValueError(f"duplicate row keys ({found['repeated']}): {[r.asDict() for r in duplicate_keys(rows).limit(5).collect()]}")

    publish(out.select(first, *COLUMNS[1:]), path, mode=mode, compression=compression, accept=accept, save=save)


def write_hazard(df: DataFrame, path: str, metadata: HazardMetadata, *, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Sorted by the row key, checked on the way, whole or not at all; the metadata goes with the first column's field, which survives rewriting by Spark.

    Raises ValueError with a few rows that break a rule or share a key.
    """
    _write_checked(sort_rows(conform(df)), path, metadata, compression, mode)


def write_bucketed(df: DataFrame, path: str, metadata: HazardMetadata, *, buckets: int = 512, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """As write_hazard, but dealt by cell into `buckets` sorted files, so that portfolios join it without a shuffle of the curves (read_bucketed).

    The number of buckets is the number of tasks of such a join: a few hundred MB of curves a bucket are right.
    """
    rows = conform(df).repartition(buckets, "cell_index")
    _write_checked(rows, path, metadata, compression, mode, bucketed(df.sparkSession, buckets, "cell_index"))


def read_bucketed(spark: SparkSession, path: str, query: HazardQuery | None = None) -> DataFrame:
    """A store of write_bucketed, whose layout is checked. Joins and groups by cell_index read its buckets as they lie."""
    df = _read_bucketed(spark, path, "cell_index")
    return df if query is None else select_rows(df, query)


def write_hazard_batches(spark: SparkSession, batches: Iterable[DataFrame], path: str, metadata: HazardMetadata, **how) -> None:
    """All batches as one dataset; no batch at all gives an empty, typed one."""
    rows = spark.createDataFrame([], HAZARD_SCHEMA)
    for b in batches:
        rows = rows.unionByName(conform(b))
    write_hazard(rows, path, metadata, **how)


def read_metadata(spark: SparkSession, path: str) -> HazardMetadata:
    """Raises if the dataset has other columns or no metadata."""
    schema = spark.read.parquet(path).schema
    if [(f.name, _kind(f.dataType)) for f in schema] != [(f.name, _kind(f.dataType)) for f in HAZARD_SCHEMA]:
        raise ValueError(f"{path} has no canonical hazard schema")
    text = schema[0].metadata.get(METADATA_KEY)
    if not text:
        raise ValueError(f"{path} has no hazard metadata")
    return HazardMetadata.from_json(text)


def _kind(t: T.DataType) -> T.DataType:
    """Unsigned 64-bit columns of other writers are read as decimals; cell ids of valid cells fit a long."""
    return T.LongType() if isinstance(t, T.DecimalType) and t.scale == 0 and t.precision == 20 else t


def select_rows(df: DataFrame, query: HazardQuery) -> DataFrame:
    """Filters before any cast, so that they reach the Parquet scan also where cell_index is stored unsigned."""
    out = df.filter(F.col("hazard_name") == query.hazard_name)
    for name in ("horizon", "pathway", "cell_index"):
        value = getattr(query, name)
        if value is not None:
            kind = df.schema[name].dataType
            out = out.filter(F.col(name) == F.lit(value).cast(kind))
    return out


def read_hazard(spark: SparkSession, path: str, query: HazardQuery | None = None, *, columns: list[str] | None = None, verify: bool = False) -> DataFrame:
    """All rows, or those of a query, without a job of its own.

    Stores of this library were checked when they were written. Rows of others are checked as they are read: one that breaks a rule raises. `verify`: checks rows
    and the uniqueness of keys at once, which shuffles the keys. A projection is not checked, as it need not hold what the rules ask for.
    """
    df = spark.read.parquet(path)
    known = df.schema[0].metadata.get(CHECKED_KEY)
    if query is not None:
        df = select_rows(df, query)
    if columns:
        return df.select(*columns)
    if verify:
        return validate(df)
    return conform(df) if known else checked(df)


def hazard_names(df: DataFrame) -> DataFrame:
    return df.select("hazard_name").distinct().orderBy("hazard_name")


class HazardReader(Protocol):
    def read(self, query: HazardQuery) -> DataFrame: ...


class Provider(HazardReader, Protocol):
    def list_hazards(self) -> list[str]: ...

    def metadata(self, name: str) -> HazardMetadata: ...


@dataclass(frozen=True)
class LocalProvider:
    """A provider over one stored dataset."""

    spark: SparkSession
    path: str

    def list_hazards(self) -> list[str]:
        return [r[0] for r in hazard_names(self.spark.read.parquet(self.path)).collect()]

    def metadata(self, name: str) -> HazardMetadata:
        if self.spark.read.parquet(self.path).filter(F.col("hazard_name") == name).isEmpty():
            raise LookupError(f"unknown hazard {name!r}")
        return read_metadata(self.spark, self.path)

    def read(self, query: HazardQuery) -> DataFrame:
        return read_hazard(self.spark, self.path, query)


def as_canonical(df: DataFrame) -> DataFrame:
    """Rows of another writer with unsigned ids, as canonical types."""
    return conform(df.select(*COLUMNS))
