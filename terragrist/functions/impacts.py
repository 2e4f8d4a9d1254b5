"""Impacts: functions of a hazard value, aligned with the return period of the event that they are of.

Linear, piecewise and sigmoid impacts are Column expressions. Any other function can be given as a callable over numpy
arrays; it runs in an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an impact may be told about a row besides its values.
CONTEXT = ("cell", "country", "continent", "building_type", "historic_mean")


@dataclass(frozen=True)
class LinearImpact:
    slope: float
    intercept: float = 0.0
    minimum: float | None = 0.0
    maximum: float | None = 1.0

    def column(self, value: Column, context: Mapping[str, Column]) -> Column:
        out = F.lit(float(self.slope)) * value + F.lit(float(self.intercept))
        if self.minimum is not None:
            out = F.when(out < self.minimum, float(self.minimum)).otherwise(out)
        if self.maximum is not None:
            out = F.when(out > self.maximum, float(self.maximum)).otherwise(out)
        return out


@dataclass(frozen=True)
class PiecewiseLinearImpact:
    """Straight lines between the given points, flat outside."""

    exposure: Sequence[float]
    impact: Sequence[float]

    def __post_init__(self) -> None:
        if len(self.exposure) != len(self.impact) or not self.exposure:
            raise ValueError("exposure and impact must have the same, positive length")
        if any(b <= a for a, b in zip(self.exposure, self.exposure[1:])):
            raise ValueError("exposure must increase")

    def column(self, value: Column, context: Mapping[str, Column]) -> Column:
        x, y = [float(v) for v in self.exposure], [float(v) for v in self.impact]
        out = F.when(value.isNull(), None).when(value <= x[0], y[0])
        for x0, x1, y0, y1 in zip(x, x[1:], y, y[1:]):
            out = out.when(value <= x1, F.lit(y0) + (value - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0)))
        return out.otherwise(y[-1])


@dataclass(frozen=True)
class SigmoidImpact:
    midpoint: float
    steepness: float
    maximum: float = 1.0

    def column(self, value: Column, context: Mapping[str, Column]) -> Column:
        return F.lit(float(self.maximum)) / (F.lit(1.0) + F.exp(F.lit(-float(self.steepness)) * (value - F.lit(float(self.midpoint)))))


@dataclass(frozen=True)
class CallableImpact:
    """`function(values, context)` over numpy arrays; context maps names to arrays."""

    function: Callable[[np.ndarray, Mapping[str, np.ndarray]], np.ndarray]

    def column(self, value: Column, context: Mapping[str, Column]) -> Column:
        names, function = list(context), self.function

        @F.pandas_udf(T.DoubleType())
        def run(*cols: pd.Series) -> pd.Series:
            told = {n: c.to_numpy() for n, c in zip(names, cols[1:])}
            return pd.Series(np.asarray(function(cols[0].to_numpy(float), told), dtype=float))

        return run(value, *[context[n] for n in names])


@dataclass(frozen=True)
class ImpactSpec:
    """An impact with what it means, and where its context comes from: a column, or else a default."""

    impact: object
    name: str
    unit: str
    semantics: str
    columns: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for what in ("name", "unit", "semantics"):
            if not getattr(self, what).strip():
                raise ValueError(f"impact {what} must not be blank")
        unknown = (set(self.columns) | set(self.defaults)) - set(CONTEXT)
        if unknown:
            raise ValueError(f"unknown context fields: {sorted(unknown)}")
        if not hasattr(self.impact, "column"):
            if not callable(self.impact):
                raise TypeError("impact must be callable or have a column method")
            object.__setattr__(self, "impact", CallableImpact(self.impact))

    def context(self) -> dict[str, Column]:
        """A null in a context column falls back to the default."""
        out = {}
        for name in CONTEXT:
            parts = [F.col(self.columns[name])] if name in self.columns else [F.col("cell_index")] if name == "cell" else []
            if name in self.defaults:
                parts.append(F.lit(self.defaults[name]))
            if parts:
                out[name] = F.coalesce(*parts)
        return out

    def apply(self, value: Column) -> Column:
        return self.impact.column(value, self.context())
