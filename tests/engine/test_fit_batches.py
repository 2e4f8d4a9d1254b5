"""Shapes fitted for many pixels at once, against a search of each pixel by itself."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrist.functions import fitting


def unit(family, p, c):
    """Quantiles in plain scalars."""
    e, u = -np.log(p), -np.log1p(-p)
    return {"genextreme": lambda: -np.log(e) if c == 0 else (1 - e**c) / c, "weibull_min": lambda: u ** (1 / c), "weibull_max": lambda: -(e ** (1 / c)), "genpareto": lambda: u if c == 0 else np.expm1(c * u) / c}[family]()


def alone(p, v, family):
    """The least error over a fine grid, refined twice: no golden section."""
    def error(c):
        z = unit(family, p, c)
        s = ((z - z.mean()) * (v - v.mean())).sum() / ((z - z.mean()) ** 2).sum()
        return float(np.sqrt(((v - v.mean() - s * (z - z.mean())) ** 2).mean())) if s > 0 else np.inf

    lo, hi = (0.1, 10.0) if family.startswith("weibull") else (-1.0, 1.0)
    for _ in range(6):
        grid = np.linspace(lo, hi, 201)
        at = int(np.argmin([error(c) for c in grid]))
        lo, hi = grid[max(0, at - 1)], grid[min(200, at + 1)]
    return (lo + hi) / 2, error((lo + hi) / 2)


P = np.array([0.5, 0.8, 0.9, 0.96, 0.98, 0.99, 0.998])


@pytest.mark.parametrize("family,shapes", [("genextreme", (-0.3, 0.0, 0.25)), ("genpareto", (-0.2, 0.0, 0.3)), ("weibull_min", (0.8, 2.0)), ("weibull_max", (1.2, 3.0))])
def test_pixels_together_equal_each_alone(family, shapes):
    rng = np.random.default_rng(3)
    rows = [3 + 2 * unit(family, P, c) + rng.normal(0, noise, len(P)) for c in shapes for noise in (0.0, 0.05, 0.05)]
    v = np.stack(rows)
    p = np.broadcast_to(P, v.shape)
    shape, loc, scale, rmse = fitting.fit_pixels(p, v, family)
    for i in range(len(v)):
        one = fitting.fit_knots(P, v[i], family)
        assert np.allclose(one, (shape[i], loc[i], scale[i], rmse[i]), rtol=0, atol=1e-8)
        c, error = alone(P, v[i], family)
        assert rmse[i] <= error + 1e-7 and (abs(shape[i] - c) < 1e-3 or abs(rmse[i] - error) < 1e-7)


def test_fits_of_a_table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        n = [7, 7, 5, 3, 0][i % 5]
        v = 10 + 3 * unit("genextreme", P[:n], [0.1, -0.2, 0.0][i % 3]) + (0 if i % 7 else 5 * rng.normal(size=n))
        rows += [(i, f"k{i}", float(a), float(b)) for a, b in zip(P[:n], v if i % 11 else v * 0 + 1)]
    rows += [(500, None, 0.5, float("nan")), (500, None, 0.0, 1.0)]
    k = spark.createDataFrame(rows, "pixel long, name string, probability double, value double")
    policy = fitting.FitPolicy("genextreme", max_normalized_rmse=0.02, on_failure="skip")
    got = {r["pixel"]: r for r in fitting.fit_curves(k, ["pixel", "name"], policy).collect()}
    for i in range(200):
        own = [(a, b) for j, _, a, b in rows if j == i]
        p, v = (np.array(x) for x in zip(*own)) if own else (np.empty(0), np.empty(0))
        if len(own) < 4 or v.max() == v.min():
            assert i not in got
            continue
        c, loc, s, rmse = fitting.fit_knots(p, v, "genextreme")
        assert (i in got) == (s > 0 and rmse / (v.max() - v.min()) <= 0.02)
        if i in got:
            assert np.allclose((got[i]["curve_shape"], got[i]["curve_location"], got[i]["curve_scale"]), (c, loc, s), rtol=0, atol=1e-8) and got[i]["name"] == f"k{i}"
    with pytest.raises(Exception, match="curve fit failed"):
        fitting.fit_curves(k, ["pixel"], fitting.FitPolicy("genextreme", max_normalized_rmse=0.02)).collect()
    assert fitting.fit_curves(k.filter(F.lit(False)), ["pixel"], policy).collect() == []


def test_many_pixels_are_fitted_in_seconds():
    rng = np.random.default_rng(5)
    v = 3 + 2 * np.stack([unit("genextreme", P, c) for c in rng.uniform(-0.3, 0.3, 2000)])
    p = np.broadcast_to(P, v.shape)
    began = time.perf_counter()
    fitting.fit_pixels(p, v, "genextreme")
    together = time.perf_counter() - began
    began = time.perf_counter()
    for i in range(50):
        fitting.fit_knots(P, v[i], "genextreme")
    assert together / 2000 * 10 < (time.perf_counter() - began) / 50
