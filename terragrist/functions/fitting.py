"""Fits of hazard curves to tabulated quantiles, as grouped aggregates.

A Gumbel curve is a straight line in its plotting variable, so its fit is one regression aggregate. Families with a shape
are fitted by a search over the shape, each step the same regression. The knots of a pixel are gathered as one row, and the
search runs on thousands of pixels at once, as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrist.functions.curves import FAMILIES, SHAPELESS, skewnorm_ppf


@dataclass(frozen=True)
class FitPolicy:
    """What a fit must reach; `atom_probability` asks for a hurdle curve with its atom at `atom_location`."""

    family: str = "gumbel_r"
    min_knots: int = 4
    max_normalized_rmse: float = 0.2
    max_absolute_residual: float = float("inf")
    on_failure: str = "raise"
    atom_probability: float | None = None
    atom_location: float = 0.0

    def __post_init__(self) -> None:
        if self.family not in FAMILIES:
            raise ValueError(f"unknown family {self.family!r}")
        if self.on_failure not in ("raise", "skip"):
            raise ValueError("on_failure must be raise or skip")
        if self.atom_probability is not None and not 0 < self.atom_probability < 1:
            raise ValueError("atom_probability must be in (0, 1)")
        if self.max_normalized_rmse < 0 or self.max_absolute_residual < 0:
            raise ValueError("limits must not be negative")


def knot_probability(period: Column, tail: str = "upper") -> Column:
    return F.lit(1.0) - F.lit(1.0) / period if tail == "upper" else F.lit(1.0) / period


def plotting_variable(family: str, p: Column) -> Column:
    """z with value = location + scale * z for the Gumbel families."""
    if family == "gumbel_r":
        return -F.log(-F.log(p))
    if family == "gumbel_l":
        return F.log(-F.log(F.lit(1.0) - p))
    raise ValueError(f"{family} is no line in a plotting variable")


def usable_knots(knots: DataFrame, policy: FitPolicy) -> DataFrame:
    """Finite knots (probability, value) within (0, 1); of a hurdle curve those of its tail, rescaled."""
    k = knots.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("probability") > 0) & (F.col("probability") < 1))
    a = policy.atom_probability
    return k if a is None else k.filter(F.col("probability") > a).withColumn("probability", (F.col("probability") - a) / (1 - a))


def fit_gumbel(knots: DataFrame, keys: Sequence[str], policy: FitPolicy) -> DataFrame:
    """(keys, location, scale, n, normalized_rmse, max_residual, converged) of each group of knots.

    Two passes of partial aggregation: the line, then the residuals on the joined line.
    """
    k = usable_knots(knots, policy).withColumn("z", plotting_variable(policy.family, F.col("probability")))
    line = k.groupBy(*keys).agg(F.regr_intercept("value", "z").alias("location"), F.regr_slope("value", "z").alias("scale"), F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("spread"))
    r = k.join(line, list(keys)).withColumn("r", F.col("value") - F.col("location") - F.col("scale") * F.col("z"))
    d = r.groupBy(*keys, "location", "scale", "n", "spread").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.max(F.abs("r")).alias("max_residual"))
    nrmse = F.when(F.col("spread") > 0, F.col("rmse") / F.col("spread"))
    good = (F.col("n") >= policy.min_knots) & (F.col("scale") > 0) & (nrmse <= policy.max_normalized_rmse) & (F.col("max_residual") <= policy.max_absolute_residual)
    return d.select(*keys, "location", "scale", "n", nrmse.alias("normalized_rmse"), "max_residual", F.coalesce(good, F.lit(False)).alias("converged"))


#: Pixels whose shapes are searched at once.
PIXELS_AT_ONCE = 8192


def _unit_quantiles(family: str, p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Quantiles of location 0 and scale 1 at p (pixel, knot), with one shape a pixel, or at p (knot) with one shape."""
    c = np.asarray(c, dtype=float)
    c = c[:, None] if c.ndim else c
    e, u = -np.log(p), -np.log1p(-p)
    if family in ("genextreme", "genpareto"):
        some = np.where(c == 0, 1.0, c)
        if family == "genextreme":
            return np.where(c == 0, -np.log(e), (1 - e**some) / some)
        return np.where(c == 0, u, np.expm1(some * u) / some)
    if family == "weibull_min":
        return u ** (1 / c)
    if family == "weibull_max":
        return -(e ** (1 / c))
    if family == "gumbel_r":
        return -np.log(e)
    if family == "gumbel_l":
        return np.log(u)
    return skewnorm_ppf(p.ravel(), np.broadcast_to(c, p.shape).ravel()).reshape(p.shape)


def fit_pixels(p: np.ndarray, v: np.ndarray, family: str) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """(shape, location, scale, rmse) of each row of knots: least squares, the shape by a grid and golden-section search that all rows take together."""
    mean = v.mean(axis=1)
    vc = v - mean[:, None]

    def line(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = _unit_quantiles(family, p, c)
        middle = z.mean(axis=1)
        zc = z - middle[:, None]
        ss = (zc**2).sum(axis=1)
        usable = (ss > 0) & np.isfinite(ss)
        s = np.where(usable, (zc * vc).sum(axis=1) / np.where(usable, ss, 1.0), 0.0)
        loc = mean - s * np.where(np.isfinite(middle), middle, 0.0)
        rmse = np.sqrt(((v - loc[:, None] - s[:, None] * z) ** 2).mean(axis=1))
        return loc, s, np.where(s > 0, rmse, np.inf)

    with np.errstate(all="ignore"):
        if family in SHAPELESS:
            return (None, *line(np.zeros(len(p))))
        lo, hi = (0.1, 10.0) if family.startswith("weibull") else (-8.0, 8.0) if family == "skewnorm" else (-1.0, 1.0)
        grid = np.linspace(lo, hi, 33)
        errors = np.stack([line(np.full(len(p), c))[2] for c in grid], axis=1)
        at = np.where(np.isnan(errors), np.inf, errors).argmin(axis=1)
        a, b = grid[np.maximum(0, at - 1)], grid[np.minimum(len(grid) - 1, at + 1)]
        g = (5**0.5 - 1) / 2
        for _ in range(40):
            x, y = b - g * (b - a), a + g * (b - a)
            left = line(x)[2] <= line(y)[2]
            a, b = np.where(left, a, x), np.where(left, y, b)
        c = (a + b) / 2
        return (c, *line(c))


def fit_knots(p: np.ndarray, v: np.ndarray, family: str) -> tuple[float | None, float, float, float]:
    """(shape, location, scale, rmse) of one pixel."""
    shape, loc, s, rmse = fit_pixels(np.asarray(p, dtype=float)[None], np.asarray(v, dtype=float)[None], family)
    return None if shape is None else float(shape[0]), float(loc[0]), float(s[0]), float(rmse[0])


def _fit_batch(knots: list[tuple[np.ndarray, np.ndarray]], policy: FitPolicy) -> dict[str, pa.Array]:
    """Result columns of pixels with (probabilities, values); pixels with as many knots are fitted together."""
    n = np.array([len(p) for p, _ in knots], dtype=np.int64)
    out = {c: np.full(len(n), np.nan) for c in ("shape", "location", "scale", "normalized_rmse", "max_residual")}
    fitted = np.zeros(len(n), dtype=bool)
    for size in np.unique(n):
        if size < policy.min_knots or not size:
            continue
        at = np.flatnonzero(n == size)
        p, v = (np.stack([knots[i][k] for i in at]) for k in (0, 1))
        spread = v.max(axis=1) - v.min(axis=1)
        at, p, v, spread = at[spread > 0], p[spread > 0], v[spread > 0], spread[spread > 0]
        if not len(at):
            continue
        c, loc, s, rmse = fit_pixels(p, v, policy.family)
        with np.errstate(all="ignore"):
            worst = np.abs(v - loc[:, None] - s[:, None] * _unit_quantiles(policy.family, p, c)).max(axis=1)
        found = {"shape": c, "location": loc, "scale": s, "normalized_rmse": rmse / spread, "max_residual": np.where(s > 0, worst, np.inf)}
        for name, x in found.items():
            out[name][at] = x
        fitted[at] = True
    with np.errstate(invalid="ignore"):
        good = fitted & (out["scale"] > 0) & (out["normalized_rmse"] <= policy.max_normalized_rmse) & (out["max_residual"] <= policy.max_absolute_residual)
    cols = {c: pa.array(x, mask=~fitted) for c, x in out.items()}
    return {"shape": cols["shape"], "location": cols["location"], "scale": cols["scale"], "n": pa.array(n), "normalized_rmse": cols["normalized_rmse"], "max_residual": cols["max_residual"], "converged": pa.array(good)}


def fit_curves(knots: DataFrame, keys: Sequence[str], policy: FitPolicy) -> DataFrame:
    """Canonical curve columns of each group that reaches the policy; groups that fail raise or are skipped."""
    if policy.family in SHAPELESS:
        f = fit_gumbel(knots, keys, policy).withColumn("shape", F.lit(None).cast("double"))
    else:
        gathered = usable_knots(knots, policy).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("probability").cast("double").alias("probability"), F.col("value").cast("double").alias("value")))).alias("__knots"))
        gathered = gathered.select(*keys, F.transform("__knots", lambda x: x["probability"]).alias("__p"), F.transform("__knots", lambda x: x["value"]).alias("__v"))
        places = len(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = lambda c: np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1]) if len(c) else []
            for whole in batches:
                for at in range(0, whole.num_rows, PIXELS_AT_ONCE):
                    b = whole.slice(at, PIXELS_AT_ONCE)
                    found = _fit_batch(list(zip(lists(b.column(places)), lists(b.column(places + 1)))), policy)
                    yield pa.RecordBatch.from_arrays([*b.columns[:places], *found.values()], [*b.schema.names[:places], *found])

        schema = T.StructType([T.StructField(f.name, f.dataType) for f in gathered.schema.fields[:places]])
        for name in ("shape", "location", "scale"):
            schema = schema.add(name, T.DoubleType())
        schema = schema.add("n", T.LongType()).add("normalized_rmse", T.DoubleType()).add("max_residual", T.DoubleType()).add("converged", T.BooleanType())
        f = gathered.mapInArrow(run, schema)
    if policy.on_failure == "raise":
        f = f.withColumn("converged", F.when(F.col("converged") | (F.col("n") < policy.min_knots), F.col("converged")).otherwise(F.raise_error(F.concat(F.lit("curve fit failed for "), F.to_json(F.struct(*keys))))))
    a = policy.atom_probability
    return f.filter("converged").select(
        *keys, F.lit("fitted" if a is None else "hurdle").alias("curve_kind"), F.lit(policy.family).alias("curve_type"), F.col("shape").alias("curve_shape"), F.col("location").alias("curve_location"), F.col("scale").alias("curve_scale"),
        F.lit(a).cast("double").alias("curve_atom_probability"), F.lit(None if a is None else policy.atom_location).cast("double").alias("curve_atom_location"),
    )
