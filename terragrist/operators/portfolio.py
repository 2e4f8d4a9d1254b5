"""Evaluation of asset portfolios against hazard curves.

Assets meet curves in one equi-join on the cell, with scenario filters below it; a point refines the match by the
curve's source polygon. Return-period values and impacts are Column expressions on the joined rows. The join is a sort-merge join: what
curves take once they are spelled out by scenario is far more than Spark's estimate from their files, by which it would broadcast millions of them.

Where an asset must be judged by all of its curves (ambiguous, missing, write), curves are gathered by cell below the join, so that a joined row is
an asset with its list of curves. A hot cell's assets can still be dealt to many tasks, and nothing is shuffled after the join.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terragrist.functions.curves import quantile, return_period_columns, return_period_probabilities
from terragrist.functions.geometry import covers_each, covers_point
from terragrist.functions.impacts import ImpactSpec
from terragrist.schema import COLUMNS, CURVE_COLUMNS
from terragrist.sources.publish import publish

SCENARIO = ["hazard_name", "horizon", "pathway"]
RESULT = [*SCENARIO, "source_id", "spatial_match"]
#: Scenarios that may be listed to every task (1 MB).
SCENARIOS = 10_000
#: Curves of hot cells that may be broadcast; more are joined by a shuffle.
BROADCAST_CURVES = 200_000
#: Where written evaluations and quantiles say what they hold, in the field of the first column.
EVALUATION_KEY = "terragrist.evaluation"


def scenario_filter(column: str, values: Sequence | None) -> Column | None:
    """None filters nothing, an empty sequence everything; booleans are no scenario values."""
    if values is None:
        return None
    if any(isinstance(v, bool) for v in values):
        raise TypeError(f"{column} values must not be booleans")
    return F.col(column).isin(*values) if len(values) else F.lit(False)


@dataclass(frozen=True)
class Assets:
    """A portfolio: an id, a location by longitude and latitude or by cell, and columns to pass through."""

    rows: DataFrame
    id_col: str = "asset_id"
    longitude: str | None = None
    latitude: str | None = None
    cell_col: str | None = None
    passthrough: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        have = set(self.rows.columns)
        lon, lat, cell = self.longitude, self.latitude, self.cell_col
        if lon is None and lat is None and cell is None:
            if {"longitude", "latitude"} <= have:
                lon, lat = "longitude", "latitude"
            elif "cell_index" in have:
                cell = "cell_index"
            else:
                raise ValueError("assets need longitude and latitude, or a cell column")
        if (lon is None) != (lat is None):
            raise ValueError("longitude and latitude go together")
        if lon is not None:
            cell = None
        used = [c for c in (self.id_col, lon, lat, cell) if c]
        missing = [c for c in [*used, *(self.passthrough or ())] if c not in have]
        if missing:
            raise ValueError(f"assets lack the columns {missing}")
        taken = {*used, *COLUMNS, *RESULT, "cell_index"}
        more = self.passthrough
        if more is None:
            more = tuple(c for c in self.rows.columns if c not in taken and not c.startswith("value_rp"))
        elif clash := [c for c in more if c in taken or c.startswith("value_rp")]:
            raise ValueError(f"reserved passthrough columns: {clash}")
        if len(set(more)) < len(more):
            raise ValueError("passthrough columns repeat")
        for k, v in {"longitude": lon, "latitude": lat, "cell_col": cell, "passthrough": tuple(more)}.items():
            object.__setattr__(self, k, v)

    @property
    def by_point(self) -> bool:
        return self.longitude is not None


@dataclass(frozen=True)
class Evaluation:
    """An immutable request; every method gives a new one."""

    hazard: DataFrame
    assets: Assets
    hazards: tuple[str, ...] | None = None
    horizons: tuple[int, ...] | None = None
    pathways: tuple[str, ...] | None = None
    periods: tuple[float, ...] = ()
    spec: ImpactSpec | None = None
    cell_of: object = None

    def select(self, *, hazards: Sequence[str] | None = None, horizons: Sequence[int] | None = None, pathways: Sequence[str] | None = None) -> Evaluation:
        """Narrows the scenarios; what is None stays as it was."""
        keep = lambda new, old: old if new is None else tuple(new)
        return replace(self, hazards=keep(hazards, self.hazards), horizons=keep(horizons, self.horizons), pathways=keep(pathways, self.pathways))

    def return_periods(self, periods: Sequence[float]) -> Evaluation:
        return_period_probabilities(periods)
        return_period_columns(periods)
        return replace(self, periods=tuple(periods))

    def impact(self, spec: ImpactSpec) -> Evaluation:
        return replace(self, spec=spec)

    def curves(self) -> DataFrame:
        df = self.hazard
        for column, values in (("hazard_name", self.hazards), ("horizon", self.horizons), ("pathway", self.pathways)):
            f = scenario_filter(column, values)
            df = df if f is None else df.filter(f)
        return df

    def located(self) -> DataFrame:
        """Assets as (asset_id, passthrough, [longitude, latitude], cell_index)."""
        a = self.assets
        cols = [F.col(a.id_col).alias("asset_id"), *a.passthrough]
        if a.by_point:
            if self.cell_of is None:
                raise ValueError("point assets need a function from longitude and latitude to a cell")
            return a.rows.select(*cols, F.col(a.longitude).alias("longitude"), F.col(a.latitude).alias("latitude")).withColumn("cell_index", self.cell_of(F.col("longitude"), F.col("latitude")))
        return a.rows.select(*cols, F.col(a.cell_col).cast("long").alias("cell_index"))

    def matched(self, *, spread: bool = False) -> DataFrame:
        """Assets with each of their curves. `spread`: assets of hot cells meet their curves by a broadcast, so that no cell's assets are one task's
        where the curves lie in buckets; it costs a count of assets by cell."""
        located, curves = self.located(), self.curves()
        hot = self._hot_cells(located) if spread else []
        merged = curves.hint("merge")
        m = located.filter(~F.col("cell_index").isin(*hot)).join(merged, "cell_index") if hot else located.join(merged, "cell_index")
        if hot:
            few = curves.filter(F.col("cell_index").isin(*hot))
            few = F.broadcast(few) if few.limit(BROADCAST_CURVES + 1).count() <= BROADCAST_CURVES else few.hint("merge")
            m = m.unionByName(located.filter(F.col("cell_index").isin(*hot)).join(few, "cell_index").select(*m.columns))
        if not self.assets.by_point:
            return m.withColumn("spatial_match", F.lit("h3_cell"))
        none = F.col("source_geometry").isNull()
        m = m.filter(none | covers_point(F.when(~none, F.col("source_geometry")), F.col("longitude"), F.col("latitude")))
        return m.withColumn("spatial_match", F.when(none, "h3_cell").otherwise("exact_geometry"))

    @staticmethod
    def _hot_cells(located: DataFrame, parts: int = 1000) -> list[int]:
        """Cells with more than a `parts`-th of all assets: less than `parts` by their definition."""
        counts = located.filter("cell_index is not null").groupBy("cell_index").agg(F.count(F.lit(1)).alias("n"))
        total = located.count()
        return [r[0] for r in counts.filter(F.col("n") * parts > total).select("cell_index").collect()]

    def gathered(self, *columns: str) -> DataFrame:
        """One row an asset, with the list `matches` of its curves (`columns` of them, and the scenario), empty if it has none. One exchange a side, none after."""
        by_point = self.assets.by_point
        more = ["source_geometry"] if by_point and "source_geometry" not in columns else []
        fields = list(dict.fromkeys([*SCENARIO, *columns, *more]))
        curves = self.curves().groupBy("cell_index").agg(F.collect_list(F.struct(*fields)).alias("matches"))
        m = self.located().join(curves.hint("merge"), "cell_index", "left")
        none = F.array().cast(curves.schema["matches"].dataType)
        if by_point:
            # one pass over the list: what does not cover the point goes
            held = covers_each(F.transform("matches", lambda c: c["source_geometry"]), F.col("longitude"), F.col("latitude"))
            m = m.withColumn("__held", held)
            m = m.withColumn("matches", F.filter("matches", lambda c, i: F.get(F.col("__held"), i))).drop("__held")
        return m.withColumn("matches", F.coalesce("matches", none))

    def judged(self, scenarios: int, *columns: str) -> DataFrame:
        """gathered() with `n_curves`, `n_scenarios`, and the booleans `ambiguous` (two curves of one scenario) and `incomplete` (no curve of one of the `scenarios` selected)."""
        own = F.size(F.array_distinct(F.transform("matches", lambda c: F.struct(*[c[x].alias(x) for x in SCENARIO]))))
        m = self.gathered(*columns).withColumn("n_curves", F.size("matches")).withColumn("n_scenarios", own)
        return m.withColumn("ambiguous", F.col("n_curves") > F.col("n_scenarios")).withColumn("incomplete", F.col("n_scenarios") < scenarios)

    def scenarios(self) -> list:
        """The scenarios selected; more than `SCENARIOS` are refused."""
        listed = self.curves().select(*SCENARIO).distinct().limit(SCENARIOS + 1).collect()
        if len(listed) > SCENARIOS:
            raise ValueError(f"more than {SCENARIOS} scenarios are selected; select fewer")
        return listed

    def match_counts(self) -> DataFrame:
        """Curves of each asset and scenario, as (asset_id, hazard_name, horizon, pathway, n)."""
        return self._counted(self.gathered())

    @staticmethod
    def _counted(gathered: DataFrame) -> DataFrame:
        each = F.explode(F.array_distinct("matches")).alias("s")
        n = F.size(F.filter("matches", lambda c: c == F.col("s"))).cast("long")
        return _scenario_only(gathered).select("asset_id", "matches", each).select("asset_id", *[F.col(f"s.{c}").alias(c) for c in SCENARIO], n.alias("n"))

    def ambiguous(self) -> DataFrame:
        """Assets with more than one curve of a scenario."""
        several = _scenario_only(self.gathered()).filter(F.size("matches") > F.size(F.array_distinct("matches")))
        return self._counted(several).filter("n > 1")

    def missing(self) -> DataFrame:
        """Assets without a curve of some selected scenario, with that scenario. One join; the scenarios are listed first and go along as a constant."""
        listed = self.scenarios()
        kind = "array<struct<hazard_name:string,horizon:int,pathway:string>>"
        every = F.from_json(F.lit(json.dumps([r.asDict() for r in listed])), kind)
        lacks = F.array_except(every, F.col("matches").cast(kind))
        m = _scenario_only(self.gathered()).filter(F.size(F.array_distinct("matches")) < len(listed))
        return m.select("asset_id", F.explode(lacks).alias("s")).select("asset_id", *[F.col(f"s.{c}").alias(c) for c in SCENARIO])

    def _guard_ids(self) -> None:
        ids = self.located().groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).filter("asset_id is null or n > 1").limit(10).collect()
        if ids:
            raise ValueError(f"asset ids are null or repeat: {[r.asDict() for r in ids]}")

    def _refuse(self, ambiguous: int, incomplete: int) -> None:
        for what, n, rows in (("ambiguous", ambiguous, self.ambiguous), ("missing", incomplete, self.missing)):
            if n:
                raise LookupError(f"{what} hazard curves of {n} assets: {[r.asDict() for r in rows().limit(10).collect()]}")

    def guard(self) -> None:
        """Raises ValueError for null or repeated ids, LookupError for ambiguous or missing curves, with up to ten rows. The join runs once for both; rows are looked for only where there are any."""
        self._guard_ids()
        n = self.judged(len(self.scenarios())).agg(F.count_if("ambiguous"), F.count_if("incomplete")).first()
        self._refuse(*n)

    def _values(self, *, skewnorm: bool) -> list[Column]:
        values = []
        for p, name in zip(return_period_probabilities(self.periods), return_period_columns(self.periods)):
            v = quantile(p, skewnorm=skewnorm)
            values.append((self.spec.apply(v) if self.spec else v).alias(name))
        return values

    def guarded(self, seen: Observation, *, skewnorm: bool = True) -> DataFrame:
        """What evaluate() gives, while `seen` counts `assets`, `ambiguous` and `incomplete` ones on the same rows: guards and values in one job with one join."""
        if not self.periods:
            raise ValueError("return periods are not set")
        by_point = self.assets.by_point
        m = self.judged(len(self.scenarios()), *[c for c in COLUMNS if c != "cell_index" and (c != "source_geometry" or by_point)])
        m = m.observe(seen, F.count(F.lit(1)).alias("assets"), F.count_if("ambiguous").alias("ambiguous"), F.count_if("incomplete").alias("incomplete"))
        place = ["longitude", "latitude"] if by_point else []
        m = m.select("asset_id", *self.assets.passthrough, *place, "cell_index", F.explode("matches").alias("__c"))
        m = m.select("*", "__c.*").drop("__c")
        match = F.when(F.col("source_geometry").isNull(), "h3_cell").otherwise("exact_geometry") if by_point else F.lit("h3_cell")
        return m.withColumn("spatial_match", match).select("asset_id", *self.assets.passthrough, *place, "cell_index", *RESULT, *self._values(skewnorm=skewnorm))

    def evaluate(self, *, skewnorm: bool = True, spread: bool = False) -> DataFrame:
        """One row per asset and scenario, with a value for each return period, or its impact. `spread`: see matched."""
        if not self.periods:
            raise ValueError("return periods are not set")
        m = self.matched(spread=spread)
        place = ["longitude", "latitude"] if self.assets.by_point else []
        return m.select("asset_id", *self.assets.passthrough, *place, "cell_index", *RESULT, *self._values(skewnorm=skewnorm))

    def metadata(self, unit: str | None = None) -> dict:
        """What the values are: return periods and probabilities by column, their unit, and the impact that they went through."""
        periods = {c: {"return_period": p, "probability": q} for c, p, q in zip(return_period_columns(self.periods), self.periods, return_period_probabilities(self.periods))}
        out = {"return_periods": periods, "unit": self.spec.unit if self.spec else unit}
        if self.spec:
            out["impact"] = {"name": self.spec.name, "unit": self.spec.unit, "semantics": self.spec.semantics, "interpretation": "event_aligned", "source_unit": unit}
        return out

    def write(self, path: str, *, unit: str | None = None, compression: str = "zstd", mode: str = "errorifexists") -> DataFrame:
        """Guards, evaluates and writes whole or not at all; an empty selection gives a typed, empty dataset. The request's metadata stands with the first column.

        Ambiguous and missing curves are counted on the rows that are written beside `path`; they are moved there only if there are none.
        """
        self._guard_ids()
        seen = Observation("guards")

        def accept() -> None:
            found = seen.get
            self._refuse(found["ambiguous"], found["incomplete"])

        return publish(_described(self.guarded(seen), self.metadata(unit)), path, compression=compression, mode=mode, accept=accept)


def _scenario_only(gathered: DataFrame) -> DataFrame:
    return gathered.select("asset_id", F.transform("matches", lambda c: F.struct(*[c[x].alias(x) for x in SCENARIO])).alias("matches"))


def _described(df: DataFrame, metadata: dict) -> DataFrame:
    first = df.columns[0]
    return df.select(F.col(first).alias(first, metadata={EVALUATION_KEY: json.dumps(metadata, sort_keys=True)}), *df.columns[1:])


def with_quantiles(curves: DataFrame, probabilities: Sequence[float], columns: Sequence[str], passthrough: Sequence[str], spec: ImpactSpec | None = None) -> DataFrame:
    """Passthrough columns and one double column for each probability, without a join. What an impact reads besides the value need not be passed through."""
    if len(probabilities) != len(columns) or len(set(columns)) < len(columns):
        raise ValueError("columns must be distinct, one for each probability")
    values = [(spec.apply(quantile(p, skewnorm=True)) if spec else quantile(p, skewnorm=True)).alias(c) for p, c in zip(probabilities, columns)]
    return curves.select(*passthrough, *values)


def write_quantiles(
    curves: DataFrame, probabilities: Sequence[float], path: str, *, columns: Sequence[str], passthrough: Sequence[str], spec: ImpactSpec | None = None, metadata: dict | None = None, mode: str = "errorifexists"
) -> int:
    """Writes with_quantiles whole or not at all, with its metadata; the rows written. Without curves the dataset is empty and typed."""
    said = {"probabilities": dict(zip(columns, probabilities))} | (metadata or {})
    return publish(_described(with_quantiles(curves, probabilities, columns, passthrough, spec), said), path, mode=mode).count()


def write_quantile(curves: DataFrame, probability: float, path: str, *, passthrough: Sequence[str], column: str = "depth_m", **how) -> int:
    """One probability, in one column."""
    return write_quantiles(curves, [probability], path, columns=[column], passthrough=passthrough, **how)


__all__ = ["Assets", "CURVE_COLUMNS", "Evaluation", "scenario_filter", "with_quantiles", "write_quantile", "write_quantiles"]
