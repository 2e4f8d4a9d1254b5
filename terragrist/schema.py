"""The canonical hazard table: fixed columns, row key, dataset metadata and row rules."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrist.functions.curves import FAMILIES, valid_curve

VERSION = "1.0"
METADATA_KEY = "terragrist.hazard"
HAZARD_SCHEMA = T.StructType(
    [
        T.StructField("cell_index", T.LongType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("source_geometry", T.BinaryType(), True),
        T.StructField("hazard_name", T.StringType(), False),
        T.StructField("horizon", T.IntegerType(), False),
        T.StructField("pathway", T.StringType(), False),
        T.StructField("curve_kind", T.StringType(), False),
        T.StructField("curve_type", T.StringType(), False),
        T.StructField("curve_shape", T.DoubleType(), True),
        T.StructField("curve_location", T.DoubleType(), False),
        T.StructField("curve_scale", T.DoubleType(), False),
        T.StructField("curve_atom_probability", T.DoubleType(), True),
        T.StructField("curve_atom_location", T.DoubleType(), True),
    ]
)
COLUMNS = HAZARD_SCHEMA.fieldNames()
ROW_KEY = ["hazard_name", "horizon", "pathway", "cell_index", "source_id"]
CURVE_COLUMNS = [c for c in COLUMNS if c.startswith("curve_")]


@dataclass(frozen=True)
class Source:
    provider: str
    dataset: str
    uri: str | None = None
    version: str | None = None


@dataclass(frozen=True)
class HazardMetadata:
    """What a dataset says about itself; all texts are non-empty and the resolution is 0 to 15."""

    resolution: int
    unit: str
    semantics: str
    producer: str
    creation_version: str
    sources: tuple[Source, ...] = ()
    probability_convention: str = "non_exceedance"
    geometry_encoding: str = "WKB"
    crs: str = "EPSG:4326"
    schema_version: str = VERSION
    row_key: tuple[str, ...] = field(default=tuple(ROW_KEY))

    def __post_init__(self) -> None:
        if isinstance(self.resolution, bool) or not 0 <= self.resolution <= 15:
            raise ValueError("resolution must be between 0 and 15")
        for name in ("unit", "semantics", "producer", "creation_version"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} must not be empty")
        if self.probability_convention != "non_exceedance":
            raise ValueError("probability_convention must be non_exceedance")
        if tuple(self.row_key) != tuple(ROW_KEY):
            raise ValueError(f"row_key must be {ROW_KEY}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> HazardMetadata:
        d = json.loads(text)
        return cls(**d | {"sources": tuple(Source(**s) for s in d.get("sources", ())), "row_key": tuple(d["row_key"])})


def conform(df: DataFrame) -> DataFrame:
    """`df` with the canonical types; the 13 columns must be there in order."""
    if df.columns != COLUMNS:
        raise ValueError(f"hazard columns must be {COLUMNS}, found {df.columns}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HAZARD_SCHEMA])


def row_fault() -> Column:
    """The first rule that a row breaks, or null."""
    rules = [(F.col(f.name).isNull(), f"{f.name} is null") for f in HAZARD_SCHEMA if not f.nullable]
    rules += [(F.trim(c) == "", f"{c} is empty") for c in ("source_id", "hazard_name", "pathway", "curve_kind", "curve_type")]
    rules += [(~F.col("curve_kind").isin("fitted", "hurdle"), "unknown curve_kind"), (~F.col("curve_type").isin(*FAMILIES), "unknown curve_type"), (~F.coalesce(valid_curve(), F.lit(False)), "invalid curve parameters")]
    out = F.lit(None).cast("string")
    for broken, what in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), what).otherwise(out)
    return out


def invalid_rows(df: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rule in `fault`."""
    return df.withColumn("fault", row_fault()).filter("fault is not null")


def checked(df: DataFrame) -> DataFrame:
    """The conformed table; a row that breaks a rule raises when it is computed. The rules hang on curve_scale, so that filters on other columns still reach the scan."""
    out = conform(df)
    fault = row_fault()
    told = F.raise_error(F.concat(F.lit("invalid hazard row: "), fault, F.lit(" in "), F.to_json(F.struct(*ROW_KEY)))).cast("double")
    return out.select(*[F.when(fault.isNull(), F.col(c)).otherwise(told).alias(c) if c == "curve_scale" else F.col(c) for c in COLUMNS])


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Row keys that occur more than once, with `n`."""
    return df.groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validate(df: DataFrame, unique: bool = True) -> DataFrame:
    """The conformed table; raises ValueError with a few offending rows. One aggregate for the rules, one for the key."""
    df = conform(df)
    bad = invalid_rows(df).select(*ROW_KEY, "fault").limit(5).collect()
    if bad:
        raise ValueError(f"invalid hazard rows: {[r.asDict() for r in bad]}")
    twice = duplicate_keys(df).limit(5).collect() if unique else []
    if twice:
        raise ValueError(f"duplicate row keys: {[r.asDict() for r in twice]}")
    return df
