"""Quantiles of fitted hazard curves as Column expressions.

A curve has a kind (`fitted`, or `hurdle` with an atom below its tail), a family, a location, a scale and, for most families, a
shape, in the usual parameterisation of scientific Python. Six families have closed forms and stay in generated code;
the skew-normal is inverted numerically in an Arrow UDF, which runs only where such rows are asked for.
"""

from __future__ import annotations

import math
import numbers
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = ("genextreme", "weibull_min", "weibull_max", "skewnorm", "gumbel_r", "gumbel_l", "genpareto")
SHAPELESS = ("gumbel_r", "gumbel_l")
_INF = float("inf")


def return_period_probabilities(periods: Sequence[float]) -> list[float]:
    """Non-exceedance probability 1 - 1/RP of each return period: finite, over 1, distinct, at least one."""
    out: list[float] = []
    if not len(periods):
        raise ValueError("at least one return period is needed")
    for p in periods:
        if isinstance(p, bool) or not isinstance(p, numbers.Real):
            raise TypeError(f"return period {p!r} is not a number")
        if not math.isfinite(p) or p <= 1:
            raise ValueError(f"return period {p!r} must be finite and greater than 1")
        out.append(1 - 1 / p)
    if len({float(p) for p in periods}) < len(out):
        raise ValueError("return periods must be distinct")
    return out


def return_period_columns(periods: Sequence[float]) -> list[str]:
    """value_rp25 for 25 and 25.0, value_rp2_5 for 2.5."""
    names = [f"value_rp{format(float(p), 'f').rstrip('0').rstrip('.').replace('.', '_')}" for p in periods]
    if len(set(names)) < len(names):
        raise ValueError(f"return periods share a column name: {names}")
    return names


def closed_form(family: Column, shape: Column, location: Column, scale: Column, q: Column, interior: bool = False) -> Column:
    """Quantile at q, a Column in [0, 1]; the ends give the support's bounds. Null for other families.

    `interior` promises 0 < q < 1 where it matters, which keeps the expression small enough for generated code.
    """
    inner = q if interior else F.when((q > 0) & (q < 1), q)  # logarithms see 0 < q < 1 only
    e = -F.log(inner)
    u = -F.log(F.lit(1.0) - inner)
    c = shape
    flat = F.coalesce(shape, F.lit(0.0)) == 0
    inside = (
        F.when((family == "gumbel_r") | (family == "genextreme") & flat, location - scale * F.log(e))
        .when(family == "gumbel_l", location + scale * F.log(u))
        .when(family == "genextreme", location + scale * (F.lit(1.0) - F.pow(e, c)) / c)
        .when(family == "weibull_min", location + scale * F.pow(u, F.lit(1.0) / c))
        .when(family == "weibull_max", location - scale * F.pow(e, F.lit(1.0) / c))
        .when(family == "genpareto", F.when(flat, location + scale * u).otherwise(location + scale * (F.exp(c * u) - 1) / c))
    )
    if interior:
        return inside
    # bounds of the support; families not named here are open at that end
    at0 = F.when(family.isin("weibull_min", "genpareto"), location).when((family == "genextreme") & (c < 0), location + scale / c).otherwise(-_INF)
    at1 = F.when(family == "weibull_max", location).when((family == "genextreme") & (c > 0), location + scale / c).when((family == "genpareto") & (c < 0), location - scale / c).otherwise(_INF)
    return F.when(~family.isin(*[f for f in FAMILIES if f != "skewnorm"]), None).when(q <= 0, at0).when(q >= 1, at1).otherwise(inside)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2))


def skewnorm_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Normal distribution function less twice Owen's T, by quadrature; |shape| over 1 through T's symmetry."""

    def owen(h: np.ndarray, a: np.ndarray) -> np.ndarray:
        t = (_NODES + 1) / 2 * a[:, None]
        return (np.exp(-0.5 * h[:, None] ** 2 * (1 + t**2)) / (1 + t**2) * _WEIGHTS).sum(axis=1) * a / (4 * math.pi)

    a, h = np.abs(shape), np.abs(x)
    inside = a <= 1
    t = owen(h, np.where(inside, a, 0.0))
    if not inside.all():
        safe = np.where(inside, 1.0, a)
        other = 0.25 - 0.25 * (2 * _normal_cdf(h) - 1) * (2 * _normal_cdf(safe * h) - 1) - owen(safe * h, 1 / safe)
        t = np.where(inside, t, other)
    return _normal_cdf(x) - 2 * np.sign(shape) * t


def skewnorm_ppf(q: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Inverse by Newton's method within a bracket, for each pair of a probability and a shape once; every third step halves the bracket, so no row takes over 210."""
    pairs, at = np.unique(np.stack([q, shape], axis=1), axis=0, return_inverse=True)
    return _inverted(pairs[:, 0], pairs[:, 1])[at.reshape(-1)]


def _inverted(q: np.ndarray, shape: np.ndarray) -> np.ndarray:
    out, open_ = np.where(q <= 0, -np.inf, np.where(q >= 1, np.inf, np.nan)), np.flatnonzero((q > 0) & (q < 1))
    p, a = q[open_], shape[open_]
    lo, hi, x = np.full(len(open_), -40.0), np.full(len(open_), 40.0), np.zeros(len(open_))
    for n in range(210):
        off = skewnorm_cdf(x, a) - p
        below = off < 0
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        density = 2 / math.sqrt(2 * math.pi) * np.exp(-0.5 * x * x) * _normal_cdf(a * x)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            new = x - off / density
        new = np.where((new >= lo) & (new <= hi) & (n % 3 < 2), new, (lo + hi) / 2)
        exact = np.abs(off) <= 1e-15 * np.minimum(p, 1 - p)  # as near as the distribution function is known
        new = np.where(exact, x, new)
        done = exact | (np.abs(new - x) <= 1e-15 * np.maximum(1.0, np.abs(x))) | (hi - lo <= 1e-15 * np.maximum(1.0, np.abs(x)))
        out[open_[done]] = new[done]
        open_, p, a, lo, hi, x = (v[~done] for v in (open_, p, a, lo, hi, new))
        if not len(open_):
            break
    out[open_] = x
    return out


@F.pandas_udf(T.DoubleType())
def _skewnorm(q: pd.Series, shape: pd.Series, location: pd.Series, scale: pd.Series) -> pd.Series:
    out = np.full(len(q), np.nan)
    ok = (q.notna() & shape.notna()).to_numpy()
    if ok.any():
        out[ok] = location[ok] + scale[ok] * skewnorm_ppf(q[ok].to_numpy(float), shape[ok].to_numpy(float))
    return pd.Series(out)


def quantile(probability: float | Column, *, skewnorm: bool = False, prefix: str = "curve_") -> Column:
    """The curve's value at a non-exceedance probability, from the columns curve_kind, curve_type and so on.

    A hurdle curve gives its atom up to the atom's probability and its tail, rescaled, above. Skew-normal rows are null
    unless `skewnorm` is set, since their UDF would run for every row of the plan.
    """
    col = lambda n: F.col(f"{prefix}{n}")
    if not isinstance(probability, Column) and not (isinstance(probability, numbers.Real) and 0 <= probability <= 1):
        raise ValueError(f"probability {probability!r} must be in [0, 1]")
    p = probability if isinstance(probability, Column) else F.lit(float(probability))
    a = col("atom_probability")
    hurdle = col("kind") == "hurdle"
    q = F.when(hurdle, (p - a) / (F.lit(1.0) - a)).otherwise(p)
    # a number within (0, 1) stays there: at or below the atom's probability the tail is not asked
    interior = not isinstance(probability, Column) and 0 < probability < 1
    value = closed_form(col("type"), col("shape"), col("location"), col("scale"), q, interior)
    if skewnorm:
        asked = F.when(col("type") == "skewnorm", q)
        value = F.when(col("type") == "skewnorm", _skewnorm(asked, col("shape"), col("location"), col("scale"))).otherwise(value)
    return F.when(hurdle & (p <= a), col("atom_location")).otherwise(value)


def valid_curve(prefix: str = "curve_") -> Column:
    """True for parameters that make a curve: positive finite scale, finite location, a shape where the family has one (over 0 for
    Weibull), no atom for fitted curves, an atom of probability within (0, 1) for hurdle curves."""
    col = lambda n: F.col(f"{prefix}{n}")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _INF)
    shape = col("type").isin(*SHAPELESS) | finite(col("shape")) & (~col("type").isin("weibull_min", "weibull_max") | (col("shape") > 0))
    fitted = (col("kind") == "fitted") & col("atom_probability").isNull() & col("atom_location").isNull()
    hurdle = (col("kind") == "hurdle") & finite(col("atom_location")) & finite(col("atom_probability")) & (col("atom_probability") > 0) & (col("atom_probability") < 1)
    return col("type").isin(*FAMILIES) & finite(col("location")) & finite(col("scale")) & (col("scale") > 0) & shape & (fitted | hurdle)


def _row_at(value: Any, row_index: int) -> Mapping[str, Any]:
    if isinstance(row_index, bool) or not isinstance(row_index, int):
        raise TypeError("row_index must be a whole number")
    if isinstance(value, Row):
        value = value.asDict()
    rows = 1 if isinstance(value, Mapping) else getattr(value, "num_rows", None)
    if rows is None:
        raise TypeError("a curve is read from a mapping, a row of Spark or an Arrow table")
    if not 0 <= row_index < rows:
        raise IndexError(f"row {row_index} of {rows}")
    return value if isinstance(value, Mapping) else value.slice(row_index, 1).to_pylist()[0]


@dataclass(frozen=True)
class Curve:
    """One curve of a stored row. The same rules hold as for rows of a store; values are computed by Spark, with the expressions that tables use."""

    kind: str
    type: str
    shape: float | None
    location: float
    scale: float
    atom_probability: float | None = None
    atom_location: float | None = None

    def __post_init__(self) -> None:
        number = lambda x: isinstance(x, numbers.Real) and not isinstance(x, bool) and math.isfinite(x)
        atom = (self.atom_probability, self.atom_location)
        if self.kind not in ("fitted", "hurdle") or self.type not in FAMILIES:
            raise ValueError(f"unknown curve {self.kind} {self.type}")
        if not number(self.location) or not number(self.scale) or self.scale <= 0:
            raise ValueError("a curve needs a finite location and a positive scale")
        if self.type not in SHAPELESS and not number(self.shape) or self.type in ("weibull_min", "weibull_max") and self.shape <= 0:
            raise ValueError(f"a {self.type} curve needs a shape" + ", over 0" * self.type.startswith("weibull"))
        if self.kind == "fitted" and atom != (None, None):
            raise ValueError("a fitted curve has no atom")
        if self.kind == "hurdle" and not (number(atom[0]) and 0 < atom[0] < 1 and number(atom[1])):
            raise ValueError("a hurdle curve needs an atom with a probability within (0, 1) and a finite location")

    @classmethod
    def from_row(cls, value: Any, row_index: int = 0, *, prefix: str = "curve_") -> Curve:
        """The curve of a mapping, of a Row, or of one row of an Arrow table."""
        row = _row_at(value, row_index)
        names = list(cls.__dataclass_fields__)
        missing = [f"{prefix}{n}" for n in names if f"{prefix}{n}" not in row]
        if missing:
            raise ValueError(f"the row has no column {missing[0]!r}")
        found = (row[f"{prefix}{n}"] for n in names)
        return cls(*[v.as_py() if hasattr(v, "as_py") else v for v in found])

    def columns(self, prefix: str = "curve_") -> dict[str, Column]:
        """The parameters as literal columns, for the expressions of this module."""
        return {f"{prefix}{n}": F.lit(getattr(self, n)).cast("string" if n in ("kind", "type") else "double") for n in self.__dataclass_fields__}

    def quantiles(self, spark: SparkSession, probabilities: Sequence[float]) -> list[float]:
        """Values at non-exceedance probabilities."""
        one = spark.range(1).select(*[c.alias(n) for n, c in self.columns().items()])
        return list(one.select(*[quantile(p, skewnorm=self.type == "skewnorm").alias(f"v{i}") for i, p in enumerate(probabilities)]).first())

    def return_values(self, spark: SparkSession, periods: Sequence[float]) -> list[float]:
        return self.quantiles(spark, return_period_probabilities(periods))


@dataclass(frozen=True)
class TabulatedCurve:
    """A curve known at some non-exceedance probabilities, in order, straight between them and level beyond the first and last."""

    probabilities: tuple[float, ...]
    values: tuple[float, ...]

    def __post_init__(self) -> None:
        p, v = self.probabilities, self.values
        if len(p) != len(v) or len(p) < 2:
            raise ValueError("a tabulated curve needs two knots or more, with a value each")
        if any(a >= b for a, b in zip(p, p[1:])) or not 0 <= p[0] or p[-1] > 1:
            raise ValueError("probabilities must rise within [0, 1]")
        if any(a > b for a, b in zip(v, v[1:])):
            raise ValueError("values must not fall with their probability")

    @classmethod
    def from_return_periods(cls, periods: Sequence[float], values: Sequence[float], tail: str = "upper") -> TabulatedCurve:
        """Of return periods of exceedance (upper) or of falling short (lower), in any order."""
        if tail not in ("upper", "lower"):
            raise ValueError("tail must be upper or lower")
        at = return_period_probabilities(periods)
        knots = sorted((p if tail == "upper" else 1 - p, float(v)) for p, v in zip(at, values))
        return cls(tuple(p for p, _ in knots), tuple(v for _, v in knots))

    def quantile(self, probability: Column | float) -> Column:
        """The value at a probability, in generated code; null where the probability is null or not within [0, 1]."""
        p = probability if isinstance(probability, Column) else F.lit(float(probability))
        out = F.when(p < 0, None).when(p <= self.probabilities[0], F.lit(self.values[0]))
        for p0, p1, v0, v1 in zip(self.probabilities, self.probabilities[1:], self.values, self.values[1:]):
            out = out.when(p <= p1, F.lit(v0) + (p - p0) * ((v1 - v0) / (p1 - p0)))
        return out.when(p <= 1, F.lit(self.values[-1]))
