"""Curves of stored rows, curves of pixels, and a provider over an inventory."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from terragrist.functions.curves import Curve, TabulatedCurve
from terragrist.functions.fitting import FitPolicy
from terragrist.operators.ingest import IngestPolicy
from terragrist.schema import COLUMNS
from terragrist.sources.inventory import Inventory, InventoryProvider
from terragrist.sources.raster import RasterMetadata, ZarrRaster

ROW = {"curve_kind": "hurdle", "curve_type": "gumbel_r", "curve_shape": None, "curve_location": 3.0, "curve_scale": 0.5, "curve_atom_probability": 0.4, "curve_atom_location": 0.0}


def test_rows_become_curves(spark):
    curve = Curve.from_row(ROW)
    assert curve == Curve.from_row(Row(**ROW)) == Curve.from_row(pa.Table.from_pylist([ROW | {"curve_scale": 9.0}, ROW]), 1)
    tail = lambda p: 3.0 - 0.5 * math.log(-math.log((p - 0.4) / 0.6))
    assert curve.quantiles(spark, [0.1, 0.4, 0.7, 0.95]) == pytest.approx([0.0, 0.0, tail(0.7), tail(0.95)])
    assert curve.return_values(spark, [4, 40]) == pytest.approx([tail(0.75), tail(0.975)])
    bell = Curve("fitted", "skewnorm", 0.0, 1.0, 2.0)
    assert bell.quantiles(spark, [0.5, 0.8413447460685429]) == pytest.approx([1.0, 3.0], abs=1e-6)


@pytest.mark.parametrize(
    "value, index, error",
    [(ROW, 1, IndexError), (ROW, True, TypeError), (pa.Table.from_pylist([ROW]), 1, IndexError), (pa.Table.from_pylist([ROW]), -1, IndexError), (7, 0, TypeError), ({k: v for k, v in ROW.items() if k != "curve_scale"}, 0, ValueError)],
)
def test_rows_that_are_not_there(value, index, error):
    with pytest.raises(error):
        Curve.from_row(value, index)


@pytest.mark.parametrize(
    "change",
    [{"curve_kind": "other"}, {"curve_type": "normal"}, {"curve_scale": 0.0}, {"curve_scale": None}, {"curve_location": math.nan}, {"curve_type": "genpareto"}, {"curve_type": "weibull_min", "curve_shape": -1.0}, {"curve_kind": "fitted"}, {"curve_atom_probability": 1.0}, {"curve_atom_location": None}],
)
def test_rows_that_make_no_curve(change):
    with pytest.raises(ValueError):
        Curve.from_row(ROW | change)


def test_tabulated_curves(spark):
    upper = TabulatedCurve.from_return_periods([100, 2, 10], [5.0, 1.0, 3.0])
    p = [0.0, 0.5, 0.7, 0.9, 0.95, 0.999, None, 1.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(upper.quantile(F.col("p"))).collect()]
    assert got[:6] == pytest.approx(np.interp(p[:6], upper.probabilities, upper.values)) and got[6:] == [None, None]
    lower = TabulatedCurve.from_return_periods([2, 10], [4.0, 1.0], tail="lower")
    assert lower.probabilities == pytest.approx((0.1, 0.5)) and lower.values == (1.0, 4.0)
    for periods, values, tail in (([2], [1.0], "upper"), ([2, 10], [4.0, 1.0], "upper"), ([2, 10], [1.0, 4.0], "middle"), ([2, 2], [1.0, 1.0], "upper")):
        with pytest.raises(ValueError):
            TabulatedCurve.from_return_periods(periods, values, tail)


def _write(folder, name="return period (years)", values=(2, 10, 50)):
    folder.mkdir(parents=True)
    data = np.arange(3)[:, None, None] * 2.0 + np.arange(16).reshape(4, 4) / 16
    data[1:, 0, 0] = np.nan
    info = {"zarr_format": 2, "shape": [3, 4, 4], "chunks": [3, 4, 4], "dtype": "<f8", "compressor": None, "fill_value": "NaN", "order": "C", "filters": None}
    (folder / ".zarray").write_text(json.dumps(info))
    (folder / ".zattrs").write_text(json.dumps({"transform_mat3x3": [0.5, 0, 10, 0, -0.5, 50, 0, 0, 1], "index_values": list(values), "index_name": name}))
    (folder / "0.0.0").write_bytes(data.astype("<f8").tobytes())
    return data


def test_distribution_of_a_pixel(spark, tmp_path):
    data = _write(tmp_path / "a")
    raster = ZarrRaster.open(spark, str(tmp_path / "a"), RasterMetadata("flood", "depth", "ssp585", 2050, "metres", "a"))
    curve = raster.return_period_distribution(11.2, 49.3)
    assert curve.probabilities == pytest.approx((0.5, 0.9, 0.98)) and curve.values == pytest.approx(tuple(data[:, 1, 2]))
    with pytest.raises(ValueError, match="two"):
        raster.return_period_distribution(10.1, 49.9)
    _write(tmp_path / "b", name="month")
    with pytest.raises(ValueError, match="return period"):
        ZarrRaster.open(spark, str(tmp_path / "b"), raster.metadata).return_period_distribution(11.2, 49.3)


def test_provider_opens_and_canonicalizes(spark, tmp_path):
    _write(tmp_path / "store/river/ssp585_2050/indicator")
    _write(tmp_path / "store/coast/2030")
    said = [
        {"hazard_type": "river", "indicator_id": "depth", "path": "river/{scenario}_{year}", "units": "metres", "scenarios": [{"id": "ssp585", "years": [2050]}], "store_netcdf_coords": True},
        {"hazard_type": "coast", "indicator_id": "depth", "path": "coast/{year}", "units": "metres", "scenarios": [{"id": "ssp245", "years": [2030]}]},
    ]
    (tmp_path / "inventory.json").write_text(json.dumps({"resources": said}))
    provider = InventoryProvider.read(spark, str(tmp_path / "inventory.json"), f"{tmp_path}/store/")
    assert provider.inventory == Inventory.from_dict({"resources": said}) and len(provider.find(indicator_id="depth")) == 2
    chosen = provider.select(hazard_type="river").choose("ssp585", 2050)
    raster = provider.open(chosen)
    assert raster.metadata == RasterMetadata("river", "depth", "ssp585", 2050, "metres", "river/ssp585_2050") and raster.path.endswith("/indicator")
    rows = provider.canonicalize(chosen, IngestPolicy(5, "flood", "tests", "1", FitPolicy("gumbel_r", min_knots=3, max_normalized_rmse=1.0, on_failure="skip")), bounds=(10.5, 49.0, 11.5, 49.5))
    found = rows.select("hazard_name", "horizon", "pathway").distinct().collect()
    assert rows.columns == COLUMNS and [tuple(r) for r in found] == [("flood", 2050, "ssp585")]
    assert provider.open(provider.select(hazard_type="coast").choose("ssp245", 2030)).shape == (3, 4, 4)
    with pytest.raises(ValueError):
        provider.select(hazard_type="coast").choose("ssp245", 2050)
