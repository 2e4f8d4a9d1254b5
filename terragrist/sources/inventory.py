"""Inventories of gridded resources: exact selection and template resolution."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from terragrist.operators.ingest import IngestPolicy, canonicalize
from terragrist.sources.raster import Bounds, RasterMetadata, ZarrRaster


@dataclass(frozen=True)
class Resource:
    hazard_type: str
    indicator_id: str
    path: str
    model: str = ""
    group_id: str = ""
    units: str = ""
    parameters: Mapping[str, tuple] = field(default_factory=dict)
    scenarios: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    #: Beside the array stand its coordinates, so it is `indicator` in a group.
    with_coordinates: bool = False

    def choose(self, scenario: str, year: int, **parameters) -> Selection:
        """One array of the resource; the checks are those of resolve()."""
        return Selection(self, scenario, year, self.resolve(scenario, year, **parameters))

    def resolve(self, scenario: str, year: int, **parameters) -> str:
        """The path of one array. Scenario, year and the exact set of parameters must be listed."""
        if scenario not in self.scenarios:
            raise ValueError(f"scenario {scenario!r} is not one of {sorted(self.scenarios)}")
        if year not in self.scenarios[scenario]:
            raise ValueError(f"year {year} is not one of {list(self.scenarios[scenario])}")
        if set(parameters) != set(self.parameters):
            raise ValueError(f"parameters must be {sorted(self.parameters)}")
        for k, v in parameters.items():
            if v not in self.parameters[k]:
                raise ValueError(f"{k} {v!r} is not one of {list(self.parameters[k])}")
        try:
            return self.path.format(scenario=scenario, year=year, **parameters)
        except KeyError as e:
            raise ValueError(f"the path has an unresolved field {e}") from None


@dataclass(frozen=True)
class Selection:
    """One array of an inventory."""

    resource: Resource
    scenario: str
    year: int
    path: str


@dataclass(frozen=True)
class Inventory:
    resources: tuple[Resource, ...]

    @classmethod
    def from_dict(cls, data: Mapping) -> Inventory:
        out = []
        for r in data["resources"]:
            scenarios = {s["id"]: tuple(s["years"]) for s in r.get("scenarios", ())}
            out.append(Resource(r["hazard_type"], r["indicator_id"], r["path"], r.get("indicator_model_id", r.get("model", "")) or "", r.get("group_id", "") or "", r.get("units", "") or "", {k: tuple(v) for k, v in (r.get("params") or {}).items()}, scenarios, bool(r.get("store_netcdf_coords"))))
        return cls(tuple(out))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Inventory:
        """From a JSON file in any store that Spark reads."""
        return cls.from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))

    def find(self, **fields: str | None) -> list[Resource]:
        """Exact matches on any of hazard_type, indicator_id, model, group_id and units."""
        unknown = set(fields) - {"hazard_type", "indicator_id", "model", "group_id", "units"}
        if unknown:
            raise TypeError(f"unknown fields {sorted(unknown)}")
        return [r for r in self.resources if all(v is None or getattr(r, k) == v for k, v in fields.items())]

    def select(self, **fields: str | None) -> Resource:
        found = self.find(**fields)
        if len(found) != 1:
            raise LookupError(f"{len(found)} resources match {fields}; choices: {[(r.hazard_type, r.indicator_id, r.model) for r in found or self.resources]}")
        return found[0]


@dataclass(frozen=True)
class InventoryProvider:
    """The arrays of an inventory below `root`, a folder of any store that Spark reads; credentials are those of the session's file system."""

    spark: SparkSession
    inventory: Inventory
    root: str

    @classmethod
    def read(cls, spark: SparkSession, inventory: str, root: str) -> InventoryProvider:
        return cls(spark, Inventory.read(spark, inventory), root)

    def find(self, **fields: str | None) -> list[Resource]:
        return self.inventory.find(**fields)

    def select(self, **fields: str | None) -> Resource:
        return self.inventory.select(**fields)

    def open(self, chosen: Selection) -> ZarrRaster:
        """The array with its metadata; chunks are read when rows are asked for."""
        r = chosen.resource
        path = f"{self.root.rstrip('/')}/{chosen.path.strip('/')}" + "/indicator" * r.with_coordinates
        return ZarrRaster.open(self.spark, path, RasterMetadata(r.hazard_type, r.indicator_id, chosen.scenario, chosen.year, r.units, chosen.path))

    def canonicalize(self, chosen: Selection, policy: IngestPolicy, bounds: Bounds | None = None) -> DataFrame:
        """Canonical rows of the array, or of a window of it."""
        return canonicalize(self.open(chosen), policy, bounds)
