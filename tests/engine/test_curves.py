"""Quantiles, return periods, impacts and fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrist.functions import curves, fitting
from terragrist.functions.impacts import CallableImpact, ImpactSpec, LinearImpact, PiecewiseLinearImpact

FIELDS = "id int, curve_kind string, curve_type string, curve_shape double, curve_location double, curve_scale double, curve_atom_probability double, curve_atom_location double"


def _expected(family, c, p):
    e, u = -math.log(p), -math.log(1 - p)
    return {
        "gumbel_r": lambda: 1 - 2 * math.log(e),
        "gumbel_l": lambda: 1 + 2 * math.log(u),
        "genextreme": lambda: 1 + 2 * (1 - e**c) / c,
        "weibull_min": lambda: 1 + 2 * u ** (1 / c),
        "weibull_max": lambda: 1 - 2 * e ** (1 / c),
        "genpareto": lambda: 1 + 2 * ((1 - p) ** -c - 1) / c,
    }[family]()


def test_closed_forms_and_bounds(spark):
    shapes = {"genextreme": 0.1, "weibull_min": 1.1, "weibull_max": 1.1, "gumbel_r": None, "gumbel_l": None, "genpareto": 0.1}
    df = spark.createDataFrame([(i, "fitted", f, c, 1.0, 2.0, None, None) for i, (f, c) in enumerate(shapes.items())], FIELDS)
    rows = df.select("curve_type", "curve_shape", *[curves.quantile(p).alias(n) for n, p in (("a", 0.3), ("b", 0.99), ("lo", 0.0), ("hi", 1.0))]).collect()
    for r in rows:
        assert r["a"] == pytest.approx(_expected(r[0], r[1], 0.3)) and r["b"] == pytest.approx(_expected(r[0], r[1], 0.99))
    ends = {r[0]: (r["lo"], r["hi"]) for r in rows}
    assert ends["weibull_min"] == (1.0, math.inf) and ends["weibull_max"] == (-math.inf, 1.0)
    assert ends["genextreme"] == (-math.inf, 21.0) and ends["gumbel_r"] == (-math.inf, math.inf) and ends["genpareto"] == (1.0, math.inf)


def test_hurdle_and_skewnorm(spark):
    df = spark.createDataFrame([(1, "hurdle", "gumbel_r", None, 2.0, 3.0, 0.6, 0.0), (2, "fitted", "skewnorm", 0.0, 0.0, 1.0, None, None), (3, "fitted", "skewnorm", 4.0, 0.0, 1.0, None, None)], FIELDS)
    got = {r["id"]: r for r in df.select("id", curves.quantile(0.5, skewnorm=True).alias("m"), curves.quantile(0.9, skewnorm=True).alias("t")).collect()}
    assert got[1]["m"] == 0.0 and got[1]["t"] == pytest.approx(2 - 3 * math.log(-math.log(0.75)))
    assert got[2]["t"] == pytest.approx(1.2815515655, abs=1e-8)
    x = np.array([got[3]["t"]])
    grid = np.linspace(-10, x[0], 200001)
    density = 2 * np.exp(-(grid**2) / 2) / math.sqrt(2 * math.pi) * curves._normal_cdf(4 * grid)
    assert np.trapezoid(density, grid) == pytest.approx(0.9, abs=1e-6)


def test_return_periods():
    periods = [2, 4, 10, 20, 200, 400, 1.25]
    assert curves.return_period_probabilities(periods) == pytest.approx([0.5, 0.75, 0.9, 0.95, 0.995, 0.9975, 0.2])
    assert curves.return_period_columns(periods)[-2:] == ["value_rp400", "value_rp1_25"]
    for bad in ([], [1], [0], [math.inf], [20, 20.0]):
        with pytest.raises(ValueError):
            curves.return_period_probabilities(bad)
    for bad in ([True], ["25"]):
        with pytest.raises(TypeError):
            curves.return_period_probabilities(bad)


def test_validity(spark):
    rows = [(1, "fitted", "gumbel_r", None, 0.0, 1.0, None, None), (2, "fitted", "genextreme", None, 0.0, 1.0, None, None), (3, "fitted", "gumbel_r", None, 0.0, 0.0, None, None), (4, "hurdle", "gumbel_r", None, 0.0, 1.0, None, 0.0), (5, "hurdle", "gumbel_r", 9.0, 0.0, 1.0, 0.5, 0.0), (6, "fitted", "nope", None, 0.0, 1.0, None, None)]
    got = {r[0]: bool(r[1]) for r in spark.createDataFrame(rows, FIELDS).select("id", F.coalesce(curves.valid_curve(), F.lit(False))).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_impacts(spark):
    df = spark.createDataFrame([(1, 10.0, None), (2, 50.0, 5.0)], "cell_index long, v double, base double")
    lin = ImpactSpec(LinearImpact(0.1, 0.0), "l", "1", "s").apply(F.col("v"))
    piece = ImpactSpec(PiecewiseLinearImpact((0, 20), (0, 1)), "p", "1", "s").apply(F.col("v"))
    call = ImpactSpec(lambda v, ctx: v / ctx["historic_mean"], "c", "1", "s", columns={"historic_mean": "base"}, defaults={"historic_mean": 2.0})
    assert isinstance(call.impact, CallableImpact)
    assert [tuple(r) for r in df.select(lin, piece, call.apply(F.col("v"))).collect()] == [(1.0, 0.5, 5.0), (1.0, 1.0, 10.0)]
    with pytest.raises(ValueError):
        ImpactSpec(LinearImpact(1), " ", "1", "s")


@pytest.mark.parametrize("family,shape", [("gumbel_r", None), ("gumbel_l", None), ("genextreme", -0.2), ("weibull_min", 1.7), ("genpareto", 0.3)])
def test_fit_recovers_the_curve(spark, family, shape):
    p = np.array([0.5, 0.8, 0.9, 0.96, 0.98, 0.99, 0.999])
    v = 3 + 2 * fitting._unit_quantiles(family, p, shape or 0.0)
    rows = [(1, float(a), float(b)) for a, b in zip(p, v)] + [(2, 0.5, 1.0), (2, 0.9, float("nan"))]
    policy = fitting.FitPolicy(family, max_normalized_rmse=0.01, on_failure="skip")
    got = fitting.fit_curves(spark.createDataFrame(rows, "k int, probability double, value double"), ["k"], policy).collect()
    assert len(got) == 1 and got[0]["curve_location"] == pytest.approx(3, abs=1e-3) and got[0]["curve_scale"] == pytest.approx(2, abs=1e-3)
    if shape is not None:
        assert got[0]["curve_shape"] == pytest.approx(shape, abs=1e-3)


def test_failed_fit_raises(spark):
    rows = [(1, p, 5.0) for p in (0.5, 0.8, 0.9, 0.99)]
    with pytest.raises(Exception, match="curve fit failed"):
        fitting.fit_curves(spark.createDataFrame(rows, "k int, probability double, value double"), ["k"], fitting.FitPolicy()).collect()


def test_skew_normal_values_are_found_once_for_equal_curves_and_in_few_steps(monkeypatch):
    """A bisection asked for the distribution function of every row 70 times."""
    asked, cdf = [], curves.skewnorm_cdf
    monkeypatch.setattr(curves, "skewnorm_cdf", lambda x, a: asked.append(len(x)) or cdf(x, a))
    q, a = np.tile([1e-12, 0.001, 0.5, 0.99], 1000), np.repeat([-30.0, -4.0, 0.0, 1.5], 1000)
    found = curves.skewnorm_ppf(q, a)
    assert sum(asked) < 16 * 70
    assert np.allclose(cdf(found, a)[q > 1e-6], q[q > 1e-6], rtol=1e-12, atol=1e-15)
    assert curves.skewnorm_ppf(np.array([0.0, 1.0]), np.array([2.0, 2.0])).tolist() == [-np.inf, np.inf]
